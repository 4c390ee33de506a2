"""Hand-checked cases for the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import aggregates, alerts, evaluation, graph, intervals, ordering, range_vectors, rolling, scaling, text
from faultline.plans import features as plan
from faultline.schemas import require_columns
from faultline.sources import readers, sinks

MIN = 60_000_000
SAMPLE = "run_id STRING, service STRING, ts TIMESTAMP, x DOUBLE"
LABEL = "run_id STRING, service STRING, fault_type STRING, start_ts TIMESTAMP, end_ts TIMESTAMP, label_seq LONG"
WIN = "run_id STRING, service STRING, window_start TIMESTAMP, window_end TIMESTAMP"


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def near(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1e-4))


def test_rolling_is_open_on_the_left(spark, at):
    df = spark.createDataFrame([("r", "s", at(0), 1.0), ("r", "s", at(30), 2.0), ("r", "s", at(60), 4.0)], SAMPLE)
    out = rolling.rolling_stats(df, ["x"], {"1min": MIN}, layout="wide").orderBy("window_end")
    got = rows(out, "x_mean_1min", "x_std_1min", "x_min_1min", "x_max_1min")
    want = [(1, None, 1, 1), (1.5, .7071, 1, 2), (3, 1.4142, 2, 4)]
    assert all(near(g, w) for a, b in zip(got, want) for g, w in zip(a, b))


def test_rolling_skips_nulls(spark, at):
    df = spark.createDataFrame([("r", "s", at(0), 1.0), ("r", "s", at(30), None), ("r", "s", at(60), 4.0)], SAMPLE)
    out = rolling.rolling_stats(df, ["x"], {"1min": MIN}, layout="wide").orderBy("window_end")
    assert rows(out, "x_mean_1min", "x_std_1min") == [(1, None), (1, None), (4, None)]


def test_rolling_across_time_blocks(spark, at):
    """A block of four window lengths ends inside this series; every frame still sees all its rows."""
    data = [("r", "s", at(7 * i), float(i % 5)) for i in range(300)]
    out = rolling.rolling_stats(spark.createDataFrame(data, SAMPLE), ["x"], {"1min": MIN, "2min": 2 * MIN}, layout="wide")
    got = {r.window_end: (r.x_mean_1min, r.x_mean_2min) for r in out.collect()}
    for i, (_, _, ts, _) in enumerate(data):
        for k, width in enumerate((60, 120)):
            seen = [d[3] for j, d in enumerate(data) if 7 * i - width < 7 * j <= 7 * i]
            assert math.isclose(got[ts][k], sum(seen) / len(seen))


def test_rolling_log_counts_ties(spark, at):
    data = [("r", "s", at(0), "a", 1, 0, 2), ("r", "s", at(0), "b", 0, 1, 0), ("r", "s", at(60), "c", 0, 0, 1)]
    df = spark.createDataFrame(data, "run_id STRING, service STRING, ts TIMESTAMP, text STRING, is_error INT, is_warn INT, err_kw INT")
    out = rolling.rolling_log_counts(df, {"1min": MIN}, layout="wide").orderBy("window_end")
    assert rows(out, "logs_count_1min", "logs_error_count_1min", "logs_warn_count_1min", "logs_error_keywords_1min") == [(2, 1, 1, 2), (1, 0, 0, 1)]


def test_stacked_rows_hold_one_window_length(spark, at):
    df = spark.createDataFrame([("r", "s", at(0), 1.0)], SAMPLE)
    out = rolling.rolling_stats(df, ["x"], {"1min": MIN, "5min": 5 * MIN})
    assert sorted(rows(out, "window_start", "x_mean_1min", "x_mean_5min")) == [(at(-300), None, 1.0), (at(-60), 1.0, None)]


def test_pivot_drops_empty_rows_and_keeps_absent_metrics(spark, at):
    data = [("r", at(0), "s", "rps", None), ("r", at(5), "s", "rps", 2.0), ("r", at(5), "s", "rps", 4.0), ("r", None, "s", "rps", 9.0)]
    out = rolling.pivot_metrics(spark.createDataFrame(data, "run_id STRING, ts TIMESTAMP, service STRING, metric STRING, value DOUBLE"))
    assert rows(out, "ts", "rps", "eps") == [(at(5), 3.0, None)]


def test_zscore(spark, at):
    df = spark.createDataFrame([("r", "s", at(i), x) for i, x in enumerate([1.0, 1.0, 1.0, 5.0])], SAMPLE)
    out = rolling.rolling_zscore(df, "x", ["ts"], window=4, z_threshold=1.5, keys=["run_id", "service"]).orderBy("ts")
    assert rows(out, "z_score", "y_pred") == [(0, 0), (0, 0), (0, 0), (1.5, 1)]


def test_zscore_small_blocks_agree(spark, at):
    df = spark.createDataFrame([("r", "s", at(i), float((i * 37) % 11)) for i in range(200)], SAMPLE)
    a, b = (dict(rows(rolling.rolling_zscore(df, "x", ["ts"], 12, keys=["run_id"], block_rows=n), "ts", "z_score")) for n in (15, 100_000))
    assert a == b and len(a) == 200


@pytest.mark.parametrize("right,want", [([30, 90], 30), ([20, 80], 80), ([-10, 150], None), ([60], 60), ([0], 0), ([-1], None)])
def test_nearest_row(spark, at, right, want):
    left = spark.createDataFrame([("r", "s", at(60), 1.0)], SAMPLE)
    rhs = spark.createDataFrame([("r", "s", at(x), at(x - 60), float(x)) for x in right],
                                "run_id STRING, service STRING, window_end TIMESTAMP, window_start TIMESTAMP, tfidf_0 DOUBLE")
    got = intervals.attach_embeddings(left, rhs, ["tfidf_0"]).collect()[0]
    assert (got.has_embed, got.embed_window_end) == (want is not None, None if want is None else at(want))
    assert got.tfidf_0 == float(want or 0)


def test_nearest_row_prefers_shortest_window(spark, at):
    left = spark.createDataFrame([("r", "s", at(60), 1.0)], SAMPLE)
    rhs = spark.createDataFrame([("r", "s", at(60), at(-840), 15.0), ("r", "s", at(60), at(0), 1.0), ("r", "s", at(60), at(-240), 5.0)],
                                "run_id STRING, service STRING, window_end TIMESTAMP, window_start TIMESTAMP, tfidf_0 DOUBLE")
    assert rows(intervals.attach_embeddings(left, rhs, ["tfidf_0"]), "tfidf_0") == [(1.0,)]


def test_keywords_count_once_each(spark):
    df = spark.createDataFrame([("Connection refused: TIMEOUT error error",), (None,)], "t STRING")
    assert rows(df, S.error_keyword_count(F.col("t"))) == [(4,), (0,)]


def test_normalize_service(spark):
    df = spark.createDataFrame([(" simulator-user-1 ",), (None,), ("auth",)], "s STRING")
    assert rows(df, S.normalize_service(F.col("s"))) == [("user",), ("unknown",), ("auth",)]


def test_intervals_are_closed(spark, at):
    w = spark.createDataFrame([("r", "s", at(0), at(10)), ("r", "s", at(21), at(30)), ("r", "t", at(0), at(10))], WIN)
    f = spark.createDataFrame([("r", "s", "late", at(10), at(20), 2), ("r", "s", "first", at(5), at(12), 1)], LABEL)
    out = intervals.label_windows(w, f).orderBy("service", "window_start")
    assert rows(out, "y_true", "fault_type") == [(1, "first"), (0, "normal"), (0, "normal")]
    assert rows(intervals.label_points(w, f, "window_end").orderBy("service", "window_start"), "y") == [(1,), (0,), (0,)]


def test_overlap_pairs_once_over_many_bins(spark, at):
    w = spark.createDataFrame([("r", "s", at(0), at(5000))], WIN)
    f = spark.createDataFrame([("r", "s", "a", at(-5000), at(9000), 1)], LABEL)
    pairs = intervals.overlap_pairs(w, f.select("run_id", "service", "start_ts", "end_ts"), ["run_id", "service"],
                                    (F.col("window_start"), F.col("window_end")), (F.col("start_ts"), F.col("end_ts")), MIN)
    assert pairs.count() == 1


@pytest.mark.parametrize("fault,want", [((12, 14), 1), ((9, 14), 0), ((16, 20), 0), ((15, 20), 1)])
def test_future_label(spark, at, fault, want):
    w = spark.createDataFrame([("r", "s", at(0), at(10))], WIN)
    f = spark.createDataFrame([("r", "s", "x", at(fault[0]), at(fault[1]), 1)], LABEL)
    assert rows(intervals.label_future(w, f, 5_000_000), "y_future") == [(want,)]


def test_detection_delay_may_be_negative(spark, at):
    w = spark.createDataFrame([("r", "s", at(90), at(150), 1), ("r", "s", at(80), at(140), 0)], WIN + ", y_pred INT")
    f = spark.createDataFrame([("r", "s", "x", at(100), at(120), 1), ("r", "t", "x", at(100), at(120), 2)], LABEL)
    out = intervals.detection_delay(w, f).orderBy("label_seq")
    assert rows(out, "first_detect_ts", "mttd_seconds") == [(at(90), -10.0), (None, None)]
    assert rows(intervals.detection_delay(w, f, clip_zero=True).orderBy("label_seq"), "mttd_seconds") == [(0.0,), (None,)]
    assert rows(evaluation.mttd_stats(out), "n_detected", "mttd_mean_seconds", "mttd_median_seconds") == [(1, -10.0, -10.0)]


def test_fault_intervals_across_blocks(spark, at):
    data = [("r", "s", at(0), "fault_start"), ("r", "s", at(50), "fault_start"), ("r", "s", at(500), "fault_cleared"),
            ("r", "s", at(600), "fault_start"), ("r", "s", at(10), "request_ok")]
    ev = spark.createDataFrame(data, "run_id STRING, service STRING, ts TIMESTAMP, message STRING")
    out = intervals.intervals_from_events(ev, ["run_id", "service"], span_us=MIN).orderBy("start_ts")
    assert rows(out, "start_ts", "end_ts") == [(at(0), at(500)), (at(50), at(500)), (at(600), None)]


def test_dedup_alerts(spark, at):
    a = spark.createDataFrame([("r", "s", at(1), at(5), at(9), "m", .2, "one"), ("r", "s", at(2), at(6), at(9), "m", .4, "two")],
                              "run_id STRING, service STRING, window_start TIMESTAMP, window_end TIMESTAMP, ts TIMESTAMP, signal STRING, score DOUBLE, details STRING")
    assert rows(alerts.dedup_alerts(a), "window_start", "window_end", "score", "details") == [(at(1), at(6), .4, "one")]


def test_no_rule_gives_typed_empty_table(spark, at):
    w = spark.createDataFrame([("r", "s", at(0), at(10))], WIN)
    out = alerts.build_alerts(w, alerts.AlertRules(use_metric=False, use_log=False))
    assert out.count() == 0 and out.columns == alerts.ALERT_COLUMNS
    with pytest.raises(ValueError):
        alerts.build_alerts(w)


@pytest.mark.parametrize("hot", [1, 50])
def test_cooccurrence(spark, at, hot):
    data = [("a", 0), ("b", 100), ("a", 130), ("c", 300)]
    inc = spark.createDataFrame([("r", "i", s, at(t)) for s, t in data for _ in range(hot)],
                                "run_id STRING, incident_id STRING, service STRING, ts TIMESTAMP")
    w = float(2 * hot * hot)
    assert sorted(rows(graph.cooccurrence_edges(inc), "src", "dst", "weight")) == [("a", "b", w), ("b", "a", w)]


def test_cooccurrence_against_all_pairs(spark, at):
    data = [("r", f"i{n % 2}", "abcd"[(n * 7) % 4], (n * n * 13) % 2000) for n in range(120)]
    inc = spark.createDataFrame([(r, i, s, at(t)) for r, i, s, t in data], "run_id STRING, incident_id STRING, service STRING, ts TIMESTAMP")
    want = {}
    for n, (_, i, s, t) in enumerate(data):
        for _, j, u, v in data[n + 1:]:
            if i == j and s != u and abs(t - v) <= 120:
                for pair in ((s, u), (u, s)):
                    want[pair] = want.get(pair, 0.0) + 1
    assert {(a, b): w for a, b, w in rows(graph.cooccurrence_edges(inc), "src", "dst", "weight")} == want


SPANS = [("t1", "s1", None, "user", 120.0), ("t1", "s2", "s1", "auth", 80.0), ("t1", "s3", "s1", "orders", 200.0),
         ("t2", "s4", None, "user", 90.0), ("t2", "s5", "s4", "orders", 300.0), ("t3", "s6", None, "auth", 400.0)]


def test_spans(spark):
    s = spark.createDataFrame(SPANS, "trace_id STRING, span_id STRING, parent STRING, service STRING, duration_ms DOUBLE")
    assert sorted(rows(aggregates.spans_per_trace(s), "*")) == [("t1", 3), ("t2", 2), ("t3", 1)]
    assert sorted(rows(aggregates.latency_per_trace(s), "*")) == [("t1", 400.0), ("t2", 390.0), ("t3", 400.0)]
    edges = graph.span_edges(s)
    assert sorted(rows(edges, "*")) == [("user", "auth"), ("user", "orders")]
    assert sorted(rows(graph.degrees(edges), "*")) == [("auth", 1, 0), ("orders", 1, 0), ("user", 0, 2)]


def test_pagerank_with_and_without_dangling(spark):
    def plain(edges, steps=200):
        nodes = sorted({x for e in edges for x in e[:2]})
        out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
        r = {n: 1 / len(nodes) for n in nodes}
        for _ in range(steps):
            lost = sum(r[n] for n in nodes if not out[n])
            r = {n: .85 * (sum(r[a] * w / out[a] for a, b, w in edges if b == n) + lost / len(nodes)) + .15 / len(nodes) for n in nodes}
        return r
    for edges in ([("a", "b", 2.0), ("b", "a", 2.0), ("a", "c", 1.0), ("c", "a", 1.0)], [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0)]):
        got = dict(rows(graph.pagerank(spark.createDataFrame(edges, "src STRING, dst STRING, weight DOUBLE")), "service", "rank"))
        assert all(math.isclose(got[k], v, abs_tol=1e-5) for k, v in plain(edges).items()) and len(got) == 3
    assert graph.pagerank(spark.createDataFrame([], "src STRING, dst STRING, weight DOUBLE")).count() == 0


def test_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "x DOUBLE")
    got = ordering.exact_quantiles(df, [], "x", {"p50": .5, "p95": .95}).first()
    assert math.isclose(got.p50, 2.5) and math.isclose(got.p95, 3.85)


def test_quantiles_with_a_hot_value(spark):
    df = spark.createDataFrame([("g", 7.0)] * 60 + [("g", float(i)) for i in range(30)] + [("h", 1.0)], "k STRING, x DOUBLE")
    got = {r.k: (r.lo, r.mid, r.hi) for r in ordering.exact_quantiles(df, ["k"], "x", {"lo": 0.0, "mid": .5, "hi": 1.0}).collect()}
    assert got == {"g": (0.0, 7.0, 29.0), "h": (1.0, 1.0, 1.0)}


def test_histogram_quantile(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 10.0), ("a", inf, 10.0), ("b", 1.0, 0.0), ("b", inf, 4.0),
                                ("c", 1.0, 0.0), ("c", inf, 0.0), ("d", 4.0, 8.0), ("d", inf, 8.0)], "k STRING, le DOUBLE, value DOUBLE")
    got = dict(rows(range_vectors.histogram_quantile(df, ["k"], .5), "k", "quantile"))
    assert got["a"] == 1.5 and got["b"] == 1.0 and math.isnan(got["c"]) and got["d"] == 2.0


def test_rate_with_reset(spark, at):
    data = [("s", at(5 * i), v) for i, v in enumerate([10.0, 15.0, 20.0, 2.0, 7.0, 12.0, 17.0])]
    out = range_vectors.rate(spark.createDataFrame(data, "service STRING, ts TIMESTAMP, value DOUBLE"), ["service"], 30_000_000, 5_000_000)
    got = {r.eval_ts: r.rate for r in out.collect()}
    # samples at 5..30 s lie in (0, 30]: 17 - 15 + 20 added back, 5 s to the left edge is under 1.1 spacings
    assert math.isclose(got[at(30)], 22 * (25 + 5) / 25 / 30)
    assert at(0) not in got


def test_alert_needs_the_whole_hold(spark, at):
    cond = [1, 1, 1, 0, 1, 1, 1, 1]
    v = spark.createDataFrame([("s", at(10 * i), bool(c)) for i, c in enumerate(cond)] + [("t", at(0), True), ("t", at(10), True), ("t", at(40), True)],
                              "service STRING, eval_ts TIMESTAMP, c BOOLEAN")
    out = range_vectors.alert_for(v, ["service"], F.col("c"), 30_000_000, 10_000_000)
    got = {(r.service, r.eval_ts): r.state for r in out.collect()}
    assert [got["s", at(10 * i)] for i in range(8)] == ["pending"] * 3 + ["inactive"] + ["pending"] * 3 + ["firing"]
    assert got["t", at(40)] == "pending"


def test_minmax_of_one_row(spark):
    assert rows(evaluation.minmax_normalize(spark.createDataFrame([(42.0,)], "s DOUBLE"), "s", "n"), "n") == [(0.0,)]


def test_coverage(spark):
    expected = spark.createDataFrame([("user",), ("auth",), ("orders",)], "service STRING")
    observed = spark.createDataFrame([("user",), ("orders",), ("user",)], "service STRING")
    assert rows(intervals.missing_services(expected, observed), "service") == [("auth",)]


def test_vectors(spark):
    df = spark.createDataFrame([(["f3", "f1"], [10.0, 20.0]), (None, [1.0, 2.0, 3.0]), (None, [1.0]), (["f1"], [1.0, 2.0]), (None, [])],
                               "n ARRAY<STRING>, v ARRAY<DOUBLE>")
    got = rows(df.select(S.align_vector(F.col("n"), F.col("v"), ["f1", "f2", "f3"]).alias("r")), "r.vector", "r.reject")
    assert got == [([20.0, 0.0, 10.0], None), ([1.0, 2.0, 3.0], None), (None, "bad_feature_length"),
                   (None, "feature_names_mismatch"), (None, "empty_features")]


def test_single_class_scores(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y INT, score DOUBLE")
    assert math.isnan(evaluation.roc_auc(df).first()[0])
    flat = spark.createDataFrame([(0, 0), (0, 0)], "y INT, y_pred INT")
    assert tuple(evaluation.precision_recall_f1(flat).first()) == (0.0, 0.0, 0.0)


def test_ties_in_ranking_metrics(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.8), (1, 0.5), (0, 0.1)], "y INT, score DOUBLE")
    assert math.isclose(evaluation.roc_auc(df).first()[0], (0.5 + 1 + 0 + 1) / 4)
    assert math.isclose(evaluation.average_precision(df).first()[0], 0.5 * 0.5 + 0.5 * 2 / 3)


def test_best_threshold_takes_the_lowest_of_a_tie(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2)], "y INT, score DOUBLE")
    assert evaluation.best_threshold(evaluation.tune_threshold(df)).first()["threshold"] == 0.25


def test_constant_column_is_centred(spark):
    df = spark.createDataFrame([("r", 3.0, 1.0), ("r", 3.0, 3.0)], "run_id STRING, a DOUBLE, b DOUBLE")
    assert sorted(rows(scaling.standard_scale(df, ["a", "b"], ["run_id"]), "a", "b")) == [(0.0, -1.0), (0.0, 1.0)]


def test_tfidf(spark):
    docs = spark.createDataFrame([(1, "Red red blue x"), (2, "blue"), (3, "")], "d INT, text STRING")
    got = {(r.d, r.term): (r.idx, r.weight) for r in text.tfidf(docs, ["d"]).collect()}
    blue, red = math.log(4 / 3) + 1, 2 * (math.log(4 / 2) + 1)
    norm = math.hypot(blue, red)
    assert got[1, "blue"][0] == 0 and got[1, "red"][0] == 1 and len(got) == 3
    assert math.isclose(got[1, "red"][1], red / norm) and math.isclose(got[2, "blue"][1], 1.0)
    assert {r.term for r in text.tfidf(docs, ["d"], size=1).collect()} == {"blue"}


def test_merge_fills_and_renames(spark, at):
    m = spark.createDataFrame([("r", "s", at(0), at(60), None, 1.0)], WIN + ", a DOUBLE, b DOUBLE")
    logs = spark.createDataFrame([("r", "s", at(0), at(60), 5.0), ("r", "s", at(1), at(61), 9.0)], WIN + ", b DOUBLE")
    assert rows(plan.merge_features(m, logs), "a", "b", "b_logs") == [(0.0, 1.0, 5.0)]
    late = spark.createDataFrame([("r", "s", at(1), at(61), 9.0), ("r", "s", at(-300), at(60), 2.0)], WIN + ", b DOUBLE")
    assert rows(plan.merge_features(m, late), "b_logs") == [(0.0,)]
    assert rows(plan.merge_features(m, late, align="asof"), "b_logs") == [(9.0,)]


def test_temporal_split_sizes(spark, at):
    df = spark.createDataFrame([("r", "s", at(i % 7), float(i)) for i in range(53)], SAMPLE)
    out = ordering.temporal_split(df, ["ts", "x"], [0.6, 0.2])
    assert sorted(rows(out.groupBy("split_no").count(), "*")) == [(0, 31), (1, 10), (2, 12)]


def test_tables_and_columns(spark, tmp_path, at):
    df = spark.createDataFrame([("a", 1)], "k STRING, v INT")
    df.write.parquet(f"{tmp_path}/p.parquet")
    df.write.csv(f"{tmp_path}/c.csv", header=True)
    assert rows(readers.read_table(spark, f"{tmp_path}/p"), "*") == rows(readers.read_table(spark, f"{tmp_path}/c"), "*") == [("a", 1)]
    with pytest.raises(FileNotFoundError):
        readers.read_table(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError, match=r"\['run_id', 'ts'\]"):
        require_columns(df, ["ts", "run_id", "k"])
    with pytest.raises(ValueError):
        S.numeric_features(spark.createDataFrame([("r", "s", at(0), at(1))], WIN))


def test_graph_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text('{\n "edges": [{"src": "a", "dst": "b", "weight": 2},\n {"src": "a", "dst": "b"}], "type": "x"}')
    assert rows(readers.read_graph_json(spark, str(tmp_path / "g.json")), "*") == [("a", "b", 3.0)]


def test_rca_document(spark, tmp_path, at):
    inc = spark.createDataFrame([("r_inc0", "r", "a", at(0), 1.0), ("r_inc0", "r", "b", at(9), 3.0)],
                                "incident_id STRING, run_id STRING, service STRING, ts TIMESTAMP, score DOUBLE")
    cent = spark.createDataFrame([("a", 0.5)], "service STRING, centrality DOUBLE")
    sinks.write_rca_json(graph.rank_causes(inc, cent), graph.incident_summary(inc), f"{tmp_path}/rca")
    doc = spark.read.json(f"{tmp_path}/rca").first()
    assert (doc.incident_id, doc.n_alerts) == ("r_inc0", 2)
    assert [c.service for c in doc.candidates] == ["b", "a"]
    assert math.isclose(doc.candidates[0].score, 3 + 0.4 * 0.1, abs_tol=1e-9) and math.isclose(doc.candidates[1].score, 1 + 0.3 + 0.4, abs_tol=1e-9)


def test_documents_split_into_parts(spark, at):
    logs = spark.createDataFrame([("r", "s", at(i), f"w{i}") for i in range(7)] + [("r", "t", at(1), "x")],
                                 "run_id STRING, service STRING, ts TIMESTAMP, text STRING")
    got = text.bucket_documents(logs, MIN, lines_per_part=3).orderBy("service", "part")
    assert rows(got, "service", "part", "text") == [("s", 0, "w0 w1 w2"), ("s", 1, "w3 w4 w5"), ("s", 2, "w6"), ("t", 0, "x")]


def test_sides_beyond_the_bound_are_shuffled(spark, monkeypatch):
    from faultline import session
    df = spark.range(10).selectExpr("id % 2 AS k", "id AS v")
    assert "ResolvedHint" in session.sized_side(df)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert "ResolvedHint" not in session.sized_side(df)._jdf.queryExecution().analyzed().toString()


def test_failed_responses_stop_or_are_set_apart(spark):
    import pytest
    from pyspark.errors import PySparkException
    good = '{"status":"success","data":{"result":[{"metric":{"service":"a"},"values":[[1,"2"]]}]}}'
    logs = '{"status":"success","data":{"result":[{"stream":{"service":"a"},"values":[["1000","x"]]}]}}'
    for text, flatten in ((good, readers.flatten_metric_response), (logs, readers.flatten_log_response)):
        df = spark.createDataFrame([(text,), ('{"status":"error","error":"timeout"}',), ("no json",), (None,)], "payload STRING")
        with pytest.raises(PySparkException, match="failed"):
            flatten(df).collect()
        assert flatten(df, on_failure="skip").count() == 1
        assert readers.failed_responses(df).count() == 3


def test_labels_keep_the_order_of_appended_files(spark, tmp_path, at):
    def labels(kinds):
        return spark.createDataFrame([("r", "s", k, at(0), at(60)) for k in kinds], "run_id STRING, service STRING, fault_type STRING, start_ts TIMESTAMP, end_ts TIMESTAMP").coalesce(1)

    path = f"{tmp_path}/labels"
    for kinds in (["errors"], ["cpu"] * 400, ["memory"]):
        sinks.append_labels(labels(kinds), path)
    got = [r.fault_type for r in readers.read_fault_labels(spark, path).orderBy("label_seq").collect()]
    assert got == ["errors", *["cpu"] * 400, "memory"]
    window = spark.createDataFrame([("r", "s", at(0), at(30))], "run_id STRING, service STRING, window_start TIMESTAMP, window_end TIMESTAMP")
    assert intervals.label_windows(window, readers.read_fault_labels(spark, path)).first().fault_type == "errors"


def test_only_the_named_label_gives_the_service(spark):
    labels = {"__meta_docker_container_label_x_service": "mine", "__meta_docker_container_label_a_service": "other"}
    raw = spark.createDataFrame([(labels, "{}", None)], "labels MAP<STRING,STRING>, line STRING, ts TIMESTAMP")
    assert readers.relabel_logs(raw, "__meta_docker_container_label_x_service").first().service == "mine"


def test_names_lose_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\t simulator-user-1\n",)], "n STRING")
    assert df.select(S.normalize_service(F.col("n"))).first()[0] == "user"


def test_coverage_by_containment(spark):
    expected = spark.createDataFrame([("user",), ("auth",)], "service STRING")
    observed = spark.createDataFrame([("metrics", "user"), ("logs", "/x-user-1"), ("logs", "/x-auth-1"), ("traces", "auth")], "signal STRING, name STRING")
    got = {r.signal: (r.missing, r.ok) for r in intervals.coverage(expected, observed, {"metrics": "all", "logs": "all", "traces": "any", "profiles": "any"}).collect()}
    assert got == {"metrics": ("auth", False), "logs": (None, True), "traces": ("user", True), "profiles": ("auth,user", False)}


def test_all_services_of_an_incident_are_scored(spark, at):
    rows = spark.createDataFrame([("i", "r", f"s{k}", at(k), 1.0) for k in range(1200)], "incident_id STRING, run_id STRING, service STRING, ts TIMESTAMP, score DOUBLE")
    scores = spark.createDataFrame([("s0", 1.0)], "service STRING, centrality DOUBLE")
    assert graph.score_causes(rows, scores).count() == 1200
