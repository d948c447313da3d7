"""Structured Streaming versions of bar building and event scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame) -> DataFrame:
    """Event time as an instant of the session's time zone, which watermarks ask for."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream (ts, code, price, size): open, high, low, close, volume and vwap per code and window; a window is final once the watermark has passed it."""
    g = _timed(ticks).withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "code")
    out = g.agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"),
        F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
    )
    return out.select(F.col("w.start").alias("date"), "code", "open", "high", "low", "close", "volume", "vwap")


def scored_events(events: DataFrame, every: str = "1 day", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Number and clipped sum of event scores (ts, code, score) over sliding windows."""
    g = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", every, slide).alias("w"), "code")
    total = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum("score")))
    return g.agg(F.count(F.lit(1)).alias("n"), total.alias("score")).select(F.col("w.end").alias("at"), "code", "n", "score")


def first_of_each(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """A stream without repeated events; keys are forgotten once the watermark has passed them."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
