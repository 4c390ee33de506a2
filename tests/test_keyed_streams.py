"""Keyed state of the live paths: order, lifetime, bounded tables, and the newest incidents after every batch."""

import random
from datetime import timedelta

from conftest import T0
from pyspark.sql import functions as F
from test_streaming import feed

from faultline.operators import graph, intervals
from faultline.session import scratch_path
from faultline.streaming import live
from faultline.streaming.tables import CurrentTable

TICKS = "service STRING, eval_ts TIMESTAMP, hi DOUBLE, mid DOUBLE"


def streaks(conds, step, hold):
    """The states of one service's ticks in order of time."""
    out, last, n = {}, None, 0
    for t in sorted(conds):
        n = 0 if not conds[t] else n + 1 if last is not None and t - last == step else 1
        last = t
        out[t] = "inactive" if not conds[t] else "firing" if n > hold else "pending"
    return out


def test_ticks_out_of_order_give_the_ordered_states(spark, at):
    rng = random.Random(4)
    conds = {10 * i: rng.random() < 0.8 for i in range(60) if i not in (17, 40)}
    ticks = sorted(conds, key=lambda t: t + rng.uniform(0, 45))
    rows = [(s, at(t), 100.0 * conds[t], 0.0) for t in ticks for s in ("s", "t")]
    parts = [rows[i:i + 23] for i in range(0, len(rows), 23)] + [[("u", at(9000), 0.0, 0.0)]]
    got = live.run_append(live.alert_states(feed(spark, parts, TICKS), {"hot": (F.col("hi") > 50, 3)}, delay="60 seconds"), "t")
    found = {(r.service, r.eval_ts): r.state for r in got.collect() if r.service != "u"}
    assert found == {(s, at(t)): state for t, state in streaks(conds, 10, 3).items() for s in ("s", "t")}


def test_a_late_tick_changes_nothing(spark, at):
    parts = [[("s", at(10 * i), 100.0, 0.0) for i in range(4)], [("s", at(40), 100.0, 0.0)], [("s", at(0), 0.0, 0.0), ("s", at(50), 100.0, 0.0)]]
    got = live.run_append(live.alert_states(feed(spark, parts, TICKS), {"hot": (F.col("hi") > 50, 3)}), "t")
    assert [r.state for r in got.orderBy("eval_ts").collect()] == ["pending"] * 3 + ["firing"] * 3


def state_rows(spark, path, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{path}/state").count()


def test_state_is_empty_after_the_lifetime(spark, at):
    rules = {"hot": (F.col("hi") > 50, 3)}
    ticks = [(s, at(10 * i), 100.0, 0.0) for i in range(5) for s in ("s", "t")]
    kept, gone = (scratch_path(spark, "alerts") for _ in range(2))
    for path, tail in ((kept, at(60)), (gone, at(700))):
        parts = [ticks, [("u", tail, 0.0, 0.0)], [("u", tail + timedelta(seconds=1), 0.0, 0.0)]]
        live.run_append(live.alert_states(feed(spark, parts, TICKS), rules, lifetime_ms=600_000), "t", path)
    assert state_rows(spark, kept, "streak") == 3
    assert state_rows(spark, gone, "streak") == 1  # only the newest service's


def test_many_waiting_events_of_one_key(spark, at):
    schema = "run_id STRING, service STRING, ts TIMESTAMP, message STRING"
    rng = random.Random(7)
    marks = [("r", "s", at(i / 4 + rng.choice([0, 1e-5])), rng.choice(["fault_start", "fault_end", "fault_cleared"])) for i in range(3000)]
    mixed = rng.sample(marks, len(marks))
    parts = [mixed[:1500], mixed[1500:], [("r", "s", at(5000), "fault_start"), ("r", "s", at(9000), "request_ok")]]
    path = scratch_path(spark, "pairs")
    got = live.run_append(live.fault_intervals(feed(spark, parts, schema), delay="20 minutes"), "t", path)
    batch = intervals.intervals_from_events(spark.createDataFrame(marks, schema), ["run_id", "service"]).filter("end_ts IS NOT NULL")
    key = lambda df: sorted(map(tuple, df.select("start_ts", "end_ts").collect()))
    assert key(got) == key(batch) and got.count() > 500
    assert state_rows(spark, path, "waiting") == 1


def test_a_table_of_a_hundred_batches_stays_small(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], compact_every=5)
    sizes, want = [], {}
    for epoch in range(100):
        keys = [epoch % 7, 100 + epoch % 3]
        want |= {k: epoch for k in keys}
        table.upsert(spark.createDataFrame([(k, epoch) for k in keys], "k LONG, v LONG").coalesce(1), epoch)
        if epoch % 10 == 9:
            sizes.append(sum(1 for _ in (tmp_path / "t").rglob("part-*")))
            assert dict(map(tuple, table.read().collect())) == want
    assert max(sizes) <= 2 * min(sizes) + 8


def test_a_repeated_or_unfinished_batch_of_a_table(spark, tmp_path):
    table = CurrentTable(spark, str(tmp_path / "t"), ["k"], compact_every=3)
    assert table.read() is None
    for epoch in (0, 1, 1, 2, 2, 3):
        table.upsert(spark.createDataFrame([(1, epoch), (10 + epoch, epoch)], "k LONG, v LONG"), epoch)
    (tmp_path / "t" / "base-9").mkdir()  # a writer that stopped half-way
    assert dict(map(tuple, table.read().collect())) == {1: 3, 10: 0, 11: 1, 12: 2, 13: 3}


ALERTS = "incident_id STRING, run_id STRING, service STRING, ts TIMESTAMP, score DOUBLE"
GAUGES = ["place", "incident_id", "run_id", "began", "rank", "service", "score", "magnitude", "centrality", "earliness"]


def test_recent_causes_equal_the_batch_after_every_batch(spark, monkeypatch, keep=3):
    """Alerts up to nine minutes out of order, so incidents leave the newest ones and come back."""
    rng = random.Random(keep)
    alerts = []
    for i in range(24):
        start = 200 * i
        for _ in range(rng.randrange(1, 7)):
            alerts.append((f"i{i:02d}", f"r{i % 3}", rng.choice(["a", "b", "c", "d"]), T0 + timedelta(seconds=start + rng.randrange(900)), rng.choice([None, 1.0, 2.5, 4.0])))
    alerts.sort(key=lambda a: a[3] + timedelta(seconds=rng.randrange(540)))
    parts = [alerts[i:i + 12] for i in range(0, len(alerts), 12)]
    centrality = spark.createDataFrame([("a", 1.0), ("b", 0.4), ("x", 0.2)], "service STRING, centrality DOUBLE")
    causes = live.RecentCauses(spark, scratch_path(spark, "recent"), centrality, keep, 2, 600_000_000)
    seen, replace = [], causes.gauges.replace

    def noted(rows, epoch):
        replace(rows, epoch)
        seen.append(sorted(tuple(r) for r in causes.gauges.read().select(GAUGES).collect()))

    monkeypatch.setattr(causes.gauges, "replace", noted)
    causes.run(feed(spark, parts, ALERTS))
    assert len(seen) == len(parts) + 1 and seen.pop() == seen[-1]  # the last batch brings no rows
    for n, got in enumerate(seen):
        table = spark.createDataFrame([a for p in parts[:n + 1] for a in p], ALERTS)
        recent = graph.recent_incidents(table, keep)
        ranked = graph.rank_causes(table, centrality, 2).join(recent.withColumnRenamed("first_seen", "began"), "incident_id")
        order = [r.incident_id for r in recent.collect()]
        want = sorted((order.index(r.incident_id) + 1, r.incident_id, r.run_id, r.began, r["rank"], r.service, r.score, r.magnitude, r.centrality, r.earliness)
                      for r in ranked.collect())
        rounded = lambda rows: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
        assert rounded(got) == rounded(want)
    left = {r.incident_id for r in causes.departures().collect()}
    assert left == {i for a, b in zip(seen, seen[1:]) for i in {r[1] for r in a} - {r[1] for r in b}}
    assert causes.pool.read().select("incident_id").distinct().count() <= keep + 10


def test_an_incident_is_forgotten_after_its_lifetime(spark, at):
    rows = [("old", "r", "a", at(0), 1.0), ("new", "r", "a", at(5000), 1.0), ("new", "r", "a", at(5001), 1.0)]
    path = scratch_path(spark, "t")
    live.run_append(live.incident_changes(feed(spark, [[r] for r in rows], ALERTS), "1 minute", 600_000), "t", path)
    assert state_rows(spark, path, "whole") == 1 and state_rows(spark, path, "services") == 1
