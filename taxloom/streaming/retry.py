"""Uploads that are tried again: a state machine for each file with a count of attempts, a growing wait and a timer.

A failed attempt is tried again after twice the wait of the one before, at most ``LONGEST``; after ``MOST`` attempts the file waits for a user, who may
ask for another try at once.  State is one row a file and one timer; both go when the file is through.  An attempt before its time is not
made.  When the watermark passes a file's time, or an attempt after it comes first, the file is due, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts of a file, the unit of its waits and the longest of them, in microseconds.
MOST, UNIT, LONGEST = 6, 60_000_000, 30 * 60_000_000
STATE, ROWS = "attempts int, next_try long, waiting boolean", "file long, micros long, kind string, attempts int, next_try long"
FAILED, PASSED, NOW = "failed", "passed", "now"


def wait(attempts: int) -> int:
    """Microseconds until the next try after so many attempts."""
    return min(UNIT * 2**attempts, LONGEST)


def advance(state: tuple[int, int, bool] | None, at: int, kind: str) -> tuple[tuple[int, int, bool] | None, list[tuple[int, str, int, int | None]]]:
    """The state (attempts, next_try, waiting for its time) after an event and the rows (at, kind, attempts, next_try) that it gives."""
    out = []
    attempts, next_try, waiting = state or (0, 0, False)
    if waiting and at >= next_try:
        out.append((next_try, "due", attempts, next_try))
        waiting = False
    if kind == NOW:
        return ((min(attempts, MOST - 1), 0, False), [*out, (at, "asked", min(attempts, MOST - 1), 0)]) if state else (None, out)
    if attempts >= MOST or at < next_try:
        return (attempts, next_try, waiting), out
    if kind == PASSED:
        return None, [*out, (at, "done", attempts + 1, None)]
    attempts += 1
    next_try = at + wait(attempts)
    last = attempts >= MOST
    return (attempts, next_try, not last), [*out, (at, "given up" if last else "failed", attempts, None if last else next_try)]


class Retries(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("upload", STATE)

    def _timer(self, before: tuple | None, after: tuple | None) -> None:
        for old, new in ((before, after),):
            was, now = old and old[2] and old[1], new and new[2] and new[1]
            if was != now:
                if was:
                    self.handle.deleteTimer(-(-was // 1000))
                if now:
                    self.handle.registerTimer(-(-now // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for at, kind in pd.concat(rows).sort_values(["at", "event_id"])[["at", "kind"]].itertuples(index=False):
            state, said = advance(state, int(at), kind)
            out += [(key[0], *x) for x in said]
        self._timer(first, state)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if out:
            yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            attempts, next_try, waiting = self.state.get()
            if waiting and -(-next_try // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.update((attempts, next_try, False))
                yield _frame([(key[0], next_try, "due", attempts, next_try)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["file", "micros", "kind", "attempts", "next_try"])
    return made.astype({"file": "int64", "micros": "int64", "attempts": "int32", "next_try": "Int64"})


def retries(attempts: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """What happens to the files of ``attempts`` (file, event_id, ts, kind: failed, passed or now), a stream with timestamps; needs the RocksDB state store."""
    rows = attempts.withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("file").transformWithStateInPandas(Retries(), ROWS, "append", "EventTime")


def replayed(attempts: list[tuple[int, int, str]]) -> list[tuple[int, str, int, int | None]]:
    """The rows of one file's (at, event, kind), all there: the same machine without a stream; a file that isn't due by the last of them isn't reported."""
    state, out = None, []
    for at, _, kind in sorted(attempts):
        state, said = advance(state, at, kind)
        out += said
    return out
