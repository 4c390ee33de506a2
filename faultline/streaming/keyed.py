"""Stateful processors: alert holds, fault intervals and incidents, kept per key.

What arrives waits in map state under its event time, with a timer. Timers come back once the
watermark has passed them, so rows are worked off in order whatever their arrival was, one
tick or one block of time in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROWS = 10_000  # result rows of a key handed on together


class AlertHold(StatefulProcessor):
    """State of one rule for one service at each tick, and the streak it takes to fire.

    Input rows: at (microseconds), cond, hold (steps). A tick is worked off once the
    watermark is at it. `lifetime_ms` after the last one the key's state is cleared; by then a
    streak is broken anyway, as the lifetime is longer than a step.
    """

    def __init__(self, step_us: int, lifetime_ms: int):
        self.step_us, self.lifetime_ms = step_us, lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms LONG", "at LONG, cond BOOLEAN, hold LONG")
        self.streak = handle.getValueState("streak", "last LONG, length LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row["at"] // 1000,), (row["at"], row["cond"], row["hold"]))
            self.handle.registerTimer(row["at"] // 1000 - 1)  # a timer ends when the watermark is beyond it
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs() + 1
        tick = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else None
        last, length = self.streak.get() if self.streak.exists() else (None, 0)
        if tick is None:
            if last is not None and ms >= last // 1000 + self.lifetime_ms:
                self.streak.clear()
            return
        at, cond, hold = tick
        self.waiting.removeKey((ms,))
        if last is not None:
            self.handle.deleteTimer(last // 1000 + self.lifetime_ms - 1)
        length = 0 if not cond else length + 1 if last is not None and at - last == self.step_us else 1
        self.streak.update((at, length))
        self.handle.registerTimer(at // 1000 + self.lifetime_ms - 1)
        yield Row(rule=key[0], service=key[1], at=at, cond=cond, state="inactive" if not cond else "firing" if length > hold else "pending")


class FaultPairing(StatefulProcessor):
    """Pairs the fault starts of a key with the first end event after them, in event-time order.

    Input rows, as pandas: at (microseconds), is_start. Of one instant, ends come before starts.
    A row is the code at * 2 + is_start. The rows of an input batch that fall into one block of
    `block_ms` wait as one state entry, and a key has one timer, for its earliest row; so state
    is read and written per block, not per row, and one block's codes are in memory at a time.
    """

    def __init__(self, block_ms: int):
        self.block_ms = block_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block LONG, part LONG", "codes BINARY")
        self.due = handle.getValueState("due", "ms LONG, parts LONG")  # the timer's time and the entries made so far
        self.open = handle.getListState("open", "starts BINARY")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before, parts = self.due.get() if self.due.exists() else (None, 0)
        first = before
        for batch in rows:
            if not len(batch):
                continue
            codes = np.sort(batch["at"].to_numpy(np.int64) * 2 + batch["is_start"].to_numpy(np.int64))
            least = int(codes[0]) // 2000
            first = least if first is None else min(first, least)
            parts = self.keep(codes, parts)
        if first is not None:
            self.set_timer(before, first, parts)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Works off all rows before the watermark, block by block."""
        until = timerValues.getCurrentWatermarkInMs()
        names = sorted(self.waiting.keys())
        last = until // self.block_ms
        parts, first, made, size = self.due.get()[1], None, [], 0
        for block, entries in groupby((n for n in names if n[0] <= last), key=lambda n: n[0]):
            entries = list(entries)
            codes = np.sort(np.concatenate([np.frombuffer(self.waiting.getValue(n)[0], np.int64) for n in entries]))
            for n in entries:
                self.waiting.removeKey(n)
            done = int(np.searchsorted(codes, until * 2000))
            for starts, ends in self.pairs(codes[:done]):
                made.append((starts, ends))
                size += len(starts)
                if size >= ROWS:
                    yield self.intervals(key, made)
                    made, size = [], 0
            if done < len(codes):
                first = int(codes[done]) // 2000
                parts = self.keep(codes[done:], parts)
        if made:
            yield self.intervals(key, made)
        later = [n for n in names if n[0] > last]
        if first is None and later:
            first = min(int(np.frombuffer(self.waiting.getValue(n)[0], np.int64)[0]) // 2000 for n in later if n[0] == later[0][0])
        if first is None:
            self.due.clear()
        else:
            self.set_timer(None, first, parts)

    def keep(self, codes: np.ndarray, parts: int) -> int:
        """Ascending codes as one entry a block; the number of entries made so far."""
        block = codes // (2000 * self.block_ms)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for part in np.split(codes, cuts):
            self.waiting.updateValue((int(part[0]) // (2000 * self.block_ms), parts), (part.tobytes(),))
            parts += 1
        return parts

    def set_timer(self, before: int | None, first: int, parts: int) -> None:
        if before != first:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)
        self.due.update((first, parts))

    def pairs(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, their ends) from the next codes of the key in ascending order; starts without an end are kept open."""
        is_start = codes % 2 == 1
        starts, ends = codes[is_start] // 2, codes[~is_start] // 2
        if len(ends):
            if self.open.exists():
                for (held,) in self.open.get():
                    held = np.frombuffer(held, np.int64)
                    yield held, np.full(len(held), ends[0])
                self.open.clear()
            place = np.searchsorted(ends, starts, "right")  # an end of the start's own instant comes before it
            closed = place < len(ends)
            if closed.any():
                yield starts[closed], ends[place[closed]]
            starts = starts[~closed]
        if len(starts):
            self.open.appendValue((starts.tobytes(),))

    def intervals(self, key: tuple, made: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        start, end = (np.concatenate(x) for x in zip(*made))
        return pd.DataFrame({"run_id": pd.Series([key[0]] * len(start), dtype=object), "service": pd.Series([key[1]] * len(start), dtype=object),
                             "start": start, "end": end})


class IncidentState(StatefulProcessor):
    """Alert counts, score sums and first times of an incident's services; a changed incident is emitted whole.

    Input rows: run_id, service, at (microseconds), score. `lifetime_ms` (0: never) after
    the incident's last alert its state is cleared.
    """

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.services = handle.getMapState("services", "service STRING", "total DOUBLE, n LONG, first LONG")
        self.whole = handle.getValueState("whole", "run_id STRING, first LONG, last LONG, n LONG")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        run, first, last, seen = self.whole.get() if self.whole.exists() else (None, None, None, 0)
        before = last
        new: dict[str, list] = {}
        for row in rows:
            held = new.setdefault(row["service"], [0.0, 0, row["at"]])
            held[0] += row["score"] or 0.0
            held[1] += row["score"] is not None
            held[2] = min(held[2], row["at"])
            run = row["run_id"] if run is None else min(run, row["run_id"] or run)
            first = row["at"] if first is None else min(first, row["at"])
            last = row["at"] if last is None else max(last, row["at"])
            seen += 1
        for service, (total, n, at) in new.items():
            if self.services.containsKey((service,)):
                old = self.services.getValue((service,))
                total, n, at = total + old[0], n + old[1], min(at, old[2])
            self.services.updateValue((service,), (total, n, at))
        self.whole.update((run, first, last, seen))
        if self.lifetime_ms:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.lifetime_ms)
            self.handle.registerTimer(last // 1000 + self.lifetime_ms)
        for (service,), (total, n, at) in self.services.iterator():
            yield Row(incident_id=key[0], run_id=run, service=service, magnitude=total / n if n else None, first=at, began=first, version=seen)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.services.clear()
        self.whole.clear()
        return iter([])
