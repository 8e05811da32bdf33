"""Running decisions on event streams with per-key state: daily quotas by applyInPandasWithState, rate limits by transformWithState.

The session needs a state store that holds timers and expiry (`use_rocksdb`). Events of a trigger are taken in order of
time and id; decisions fall in the order in which events arrive, as a server would make them.
"""
from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.usage import IST

DAY_MS = 86_400_000
#: The setting that names the state store.
STORE = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """State with expiry and timers needs this provider; it is set for queries that start from now on."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(query: StreamingQuery, seconds: float = float("inf")) -> None:
    """Wait until a trigger has found no new rows, then stop the query; `seconds` is a limit for those who want one.

    A query with expiring state runs triggers without rows for ever, so it can't be left to end by itself. One trigger may
    take as long as its rows need."""
    until = time.time() + seconds
    try:
        while query.isActive and time.time() < until and not any(p["numInputRows"] == 0 for p in query.recentProgress):
            time.sleep(0.2)
        if query.exception():
            raise query.exception()
        if time.time() >= until:
            raise TimeoutError(f"rows were still coming after {seconds} s")
    finally:
        query.stop()


def _rows(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["t", "event_id"], ignore_index=True)


def _quota(keep_ms: int):
    """Per identity: the attempts allowed so far at each feature on each day. A rejected or exempt attempt writes nothing."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        got, now = _rows(frames), state.getCurrentProcessingTimeMs()
        before = zip(*state.get, strict=True) if state.exists else ()
        held = {(f, d): (n, at) for f, d, n, at in before if now - at < keep_ms}
        allowed, remaining = [], []
        for f, day, limit, free in zip(got["feature"], got["day"], got["limit"], got["free"], strict=True):
            at = f, None if pd.isna(day) else day.toordinal()
            used = held.get(at, (0,))[0]
            ok = bool(free) or used < limit
            if ok and not free:
                used += 1
                held[at] = used, now
            allowed.append(ok)
            remaining.append(None if free else max(0, int(limit) - used))
        if held:
            state.update(tuple(map(list, zip(*[(*k, *v) for k, v in held.items()], strict=True))))
            state.setTimeoutDuration(max(1, max(at for _, at in held.values()) + keep_ms - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": got["event_id"], "day": got["day"], "allowed": allowed, "remaining": pd.array(remaining, "Int64")})

    return decide


def daily_quota_stream(events: DataFrame, limits: Column, *, exempt: Column | None = None, offset: str = IST, keep_days: int = 2) -> DataFrame:
    """`event_id, day, allowed, remaining` of a stream (event_id, identity, feature, ts), as operators.usage.quota_decisions.

    State is one number for (identity, feature, local day); it expires keep_days after it was last written, by the clock of the
    machine, so a late event of yesterday still counts against yesterday. Exempt identities are unlimited (null remaining).
    The numbers of an identity are one state, since a call of Python for each (identity, feature, day), most of which have a
    row or two, costs far more than their rows. A trigger's rows of an identity meet in one call.
    """
    free = F.lit(False) if exempt is None else exempt
    keyed = events.select(
        "identity", F.col("feature").cast("string").alias("feature"), F.to_date(F.col("ts") + F.expr(offset)).alias("day"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), limits.cast("long").alias("limit"), free.alias("free"),
    )
    kind = dict(events.dtypes)["event_id"]
    return keyed.groupBy("identity").applyInPandasWithState(
        _quota(keep_days * DAY_MS), f"event_id {kind}, day date, allowed boolean, remaining long",
        "feature array<string>, day array<int>, n array<bigint>, at array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout,
    )


class _FixedWindow(StatefulProcessor):
    """Per key: when its window opened and how many hits it let in. The key's own timer clears a window that is over."""

    def __init__(self, key: str, limit: int, span: int):
        self.key, self.limit, self.span = key, limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "at long, n long")

    def _ends(self, at: int) -> int:
        """The first millisecond at which a hit opens a new window."""
        return (at + self.span) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got, before = _rows(rows), self.window.get()
        at, n = before if before is not None else (None, 0)
        accepted = []
        for t in got["t"]:
            if at is None or t - at > self.span:
                at, n = int(t), 0
            accepted.append(n < self.limit)
            n += accepted[-1]
        if before is None or before[0] != at:
            if before is not None:
                self.handle.deleteTimer(self._ends(before[0]))
            self.handle.registerTimer(self._ends(at))
        self.window.update((at, n))
        yield pd.DataFrame({self.key: [key[0]] * len(got), "event_id": got["event_id"], "accepted": accepted})

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame()


def fixed_rate_limit_stream(events: DataFrame, key: str, *, limit: int = 20, ttl: int = 60, late: str = "10 minutes") -> DataFrame:
    """`(key, event_id, accepted)` of a stream (event_id, key, ts), as operators.usage.rate_limit in fixed mode.

    A window opens at a key's first hit and takes `limit` hits; the first hit more than `ttl` seconds after its opening
    opens the next. When the watermark (`late` behind the newest event) passes a window's end, its timer frees the state.
    """
    kinds = dict(events.dtypes)
    timed = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    timed = timed.withColumn("t", F.unix_micros("ts"))
    return timed.groupBy(key).transformWithStateInPandas(
        _FixedWindow(key, limit, ttl * 1_000_000), f"`{key}` {kinds[key]}, event_id {kinds['event_id']}, accepted boolean", "append", "EventTime"
    )
