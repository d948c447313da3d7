"""Crossings of moving averages as a stream with state: bars wait for the watermark, are taken in order, and each code's last closes and position are kept from batch to batch and over restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "code string, ts timestamp, close double, fast double, slow double, action string, position int"


class Crossings(StatefulProcessor):
    """Per code: the last slow + 1 closes, the position, and the bars that the watermark hasn't passed yet. A timer at a bar's time wakes the code once the watermark is beyond it."""

    def __init__(self, fast: int, slow: int, long_only: bool):
        self.fast, self.slow, self.long_only = fast, slow, long_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "closes array<double>, position int")
        self.waiting = handle.getListState("waiting", "ms long, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(t.timestamp() * 1000), float(c)) for pdf in rows for t, c in zip(pdf["ts"], pdf["close"], strict=True) if c == c]
        if new:
            self.waiting.appendList(new)
            for ms in {ms for ms, _ in new}:
                self.handle.registerTimer(ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        bars = sorted(self.waiting.get())
        due, later = [b for b in bars if b[0] <= now], [b for b in bars if b[0] > now]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if not due:
            yield pd.DataFrame()
            return
        held = self.past.get() if self.past.exists() else None
        closes, position = (list(held[0]), held[1]) if held else ([], 0)
        out = []
        for ms, close in due:
            closes = [*closes, close][-(self.slow + 1) :]
            if len(closes) <= self.slow:
                continue
            fast, slow = sum(closes[-self.fast :]) / self.fast, sum(closes[-self.slow :]) / self.slow
            fast_before, slow_before = sum(closes[-self.fast - 1 : -1]) / self.fast, sum(closes[:-1][-self.slow :]) / self.slow
            target = position
            if fast > slow and fast_before <= slow_before:
                target = 1
            elif fast < slow and fast_before >= slow_before and (position > 0 or not self.long_only):
                target = 0 if self.long_only else -1
            if target != position:
                action = {(0, 1): "buy", (-1, 1): "cover,buy", (1, 0): "sell", (0, -1): "short", (1, -1): "sell,short"}[position, target]
                position = target
                out.append((key[0], pd.Timestamp(ms, unit="ms"), close, fast, slow, action, position))
        self.past.update((closes, position))
        yield pd.DataFrame(out, columns=["code", "ts", "close", "fast", "slow", "action", "position"])

    def close(self) -> None:
        pass


def crossings(bars: DataFrame, fast: int = 10, slow: int = 20, long_only: bool = True, late: str = "10 minutes") -> DataFrame:
    """A row per trade of a stream of bars (code, ts, close): operators.signals.ma_cross, as the watermark passes the bars. Bars later than `late` are dropped; bars of equal time go by their close; a null close is no bar.

    The session must keep state in RocksDB (spark.sql.streaming.stateStore.providerClass). State is bounded by the bars that wait and slow + 1 closes a code.
    """
    rows = bars.select("code", bars["ts"].cast("timestamp").alias("ts"), bars["close"].cast("double").alias("close")).withWatermark("ts", late)
    return rows.groupBy("code").transformWithStateInPandas(Crossings(fast, slow, long_only), SCHEMA, "Append", "EventTime")
