"""Fault pairing keeps rows by block of time: few state calls, and the same intervals for any block."""

import random

import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from test_streaming import feed

from faultline.operators import intervals
from faultline.streaming import keyed, live

EVENTS = "run_id STRING, service STRING, ts TIMESTAMP, message STRING"


class Handle:
    """State in memory that counts how often it is called."""

    def __init__(self):
        self.calls, self.rows, self.value, self.held = 0, {}, None, []

    def __getattribute__(self, name):
        if name in ("updateValue", "removeKey", "getValue", "keys", "update", "appendValue", "clear", "registerTimer", "deleteTimer"):
            self.calls += 1
        return object.__getattribute__(self, name)

    getMapState = getValueState = getListState = lambda self, *_: self
    updateValue = lambda self, k, v: self.rows.__setitem__(k, v)
    removeKey = lambda self, k: self.rows.pop(k)
    getValue = lambda self, k: self.rows[k]
    keys = lambda self: iter(list(self.rows))
    registerTimer = deleteTimer = lambda self, ms: None


class Value(Handle):
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    clear = lambda self: setattr(self, "value", None)


class Items(Handle):
    exists = lambda self: bool(self.held)
    get = lambda self: iter(list(self.held))
    appendValue = lambda self, v: self.held.append(v)
    clear = lambda self: self.held.clear()


def test_state_is_called_by_block_and_not_by_row():
    handle, value, items = Handle(), Value(), Items()
    handle.getValueState, handle.getListState = lambda *_: value, lambda *_: items
    pairing = keyed.FaultPairing(600_000)
    pairing.init(handle)
    marks = [(250_000 * i, i % 3 < 2) for i in range(2000)]  # every third one is an end
    for part in (marks[1::2], marks[::2]):
        frame = pd.DataFrame(part, columns=["at", "is_start"])
        assert list(pairing.handleInputRows(("r", "s"), iter([frame]), TimerValues(0, 0))) == []
    got = pd.concat(pairing.handleExpiredTimer(("r", "s"), TimerValues(0, 400_000), ExpiredTimerInfo(0)))
    until = 400_000_000  # rows before it are worked off
    ends = [t for t, is_start in marks if not is_start and t < until]
    want = [(t, min(e for e in ends if e > t)) for t, is_start in marks if is_start and t < ends[-1]]
    assert sorted(zip(got["start"], got["end"])) == want
    assert handle.calls + value.calls + items.calls < 60


def test_blocks_of_any_length_give_the_same_intervals(spark, at):
    rng = random.Random(11)
    marks = [(rng.choice("qr"), "s", at(rng.randrange(4000) / 8), rng.choice(["fault_start", "fault_end", "request_ok"])) for _ in range(900)]
    marks.sort(key=lambda m: (m[2] - at(0)).total_seconds() + rng.uniform(0, 50))
    parts = [marks[i:i + 150] for i in range(0, 900, 150)] + [[("q", "s", at(9000), "fault_end")]]
    events = spark.createDataFrame(marks, EVENTS).filter("message <> 'request_ok'")
    key = lambda df: sorted(map(tuple, df.select("run_id", "start_ts", "end_ts").collect()))
    want = key(intervals.intervals_from_events(events, ["run_id", "service"]).filter("end_ts IS NOT NULL"))
    assert len(want) > 100
    for block in (7, 60_000, 10_000_000):
        assert key(live.run_append(live.fault_intervals(feed(spark, parts, EVENTS), block_ms=block), "t")) == want
