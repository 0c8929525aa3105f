"""Streaming form of the hysteresis decoding and its change events, for events that arrive in any order within the watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CARRIED = "state int, anchor bigint, us bigint"
PENDING = "us bigint, id bigint, p double"
DECODED = "us bigint, id bigint, state int, change_us bigint"


def use_state_store(spark: SparkSession) -> None:
    """Processors with timers need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Decoder(StatefulProcessor):
    """Holds the rows whose look-ahead isn't complete and, of the rows before, the state, the last mark and the last time."""

    def __init__(self, high: float, low: float, min_run: int, gap_us: int, idle_us: int, midpoint: str):
        self.high, self.low, self.min_run, self.gap_us, self.idle_us, self.midpoint = high, low, min_run, gap_us, idle_us, midpoint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carried = handle.getValueState("carried", CARRIED)
        self.pending = handle.getListState("pending", PENDING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """New rows wait until the watermark has passed them and what they look ahead to."""
        for part in rows:
            self.pending.appendList([(int(r.us), int(r.id), float(r.p)) for r in part.itertuples()])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._advance(key, mark, True)

    def _advance(self, key, mark: int, timer: bool) -> Iterator[pd.DataFrame]:
        rows = sorted(self.pending.get()) if self.pending.exists() else []
        passed = sum(r[0] < mark for r in rows)
        # Rows ahead that may still get company before them don't count; after a long silence the series has ended.
        ended = timer and passed == len(rows) and bool(rows) and rows[-1][0] + self.idle_us < mark
        ready = passed if ended else max(0, passed - self.min_run + 1)
        out = [(*key, *r) for r in self._decide(rows, ready)]
        rows = rows[ready:]
        if rows:
            self.pending.put(rows)
        elif self.pending.exists():
            self.pending.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rows:
            later = [r[0] for r in rows if r[0] >= mark]
            at = later[min(len(later), self.min_run) - 1] if later else rows[-1][0] + self.idle_us
            self.handle.registerTimer(at // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "us", "id", "state", "change_us"]).astype({"change_us": "Int64"})

    def _decide(self, rows: list[tuple[int, int, float]], ready: int) -> Iterator[tuple]:
        state, anchor, last = self.carried.get() if self.carried.exists() else (None, None, None)
        for i in range(ready):
            us, row, p = rows[i]
            ahead = rows[i : i + self.min_run]
            whole = all(b[0] - a[0] <= self.gap_us for a, b in zip(ahead, ahead[1:], strict=False)) and all(a[2] == a[2] for a in ahead)
            gap, before = last is not None and us - last > self.gap_us, state
            if last is None or gap:
                state = int(p >= self.high)
            elif whole and min(a[2] for a in ahead) >= self.high:
                state = 1
            elif whole and max(a[2] for a in ahead) <= self.low:
                state = 0
            change = None
            if before is not None and state != before:
                start = anchor if self.midpoint == "anchor" else last
                change = start + (us - start) // 2 if gap else us
            if last is None or gap or change is not None:
                anchor = us
            last = us
            yield us, row, state, change
        if ready:
            self.carried.update((state, anchor, last))

    def close(self) -> None:
        pass


def hysteresis(stream: DataFrame, ts: str, key: str, row: str, p: str, high: float, low: float, min_run: int, gap_us: int, idle_us: int, lateness: str, midpoint: str = "anchor") -> DataFrame:
    """(key, us, id, state, change_us): each row decoded once, when the watermark has passed it and the rows that it looks ahead to.

    The states are those of the batch decoding, and change_us those of its change events (null without a change), in
    whatever micro-batches the rows come; ``row`` orders equal times. After ``idle_us`` of event time without rows, at
    least the gap, a series counts as ended and its waiting rows are decided with what they have. A key's rows wait in
    the state store, no longer than the lateness and the look-ahead.
    """
    if idle_us < gap_us:
        raise ValueError("a series can't end before its gap")
    d = stream.withWatermark(ts, lateness).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(row).cast("long").alias("id"), F.col(p).cast("double").alias("p"))
    kind = dict(d.dtypes)[key]
    decoder = Decoder(high, low, min_run, gap_us, idle_us, midpoint)
    return d.groupBy(key).transformWithStateInPandas(decoder, f"key {kind}, {DECODED}", "Append", "EventTime").withColumnRenamed("key", key)
