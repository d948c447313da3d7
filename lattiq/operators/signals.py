"""Signals of single series and of pairs: calendar, price ratio, and a vote of trend, reversal and volume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import Compiler, col
from . import indicators

#: Months and weekdays (0 is Monday) that rise and fall (fixed values).
RISING_MONTHS, FALLING_MONTHS, RISING_DAYS, FALLING_DAYS = (1, 2, 3, 11, 12), (5, 6, 7, 8, 9), (4,), (0,)
#: Least strength of a trend, bounds of the strength index, bars of the volume mean (fixed values).
TREND, OVERSOLD, OVERBOUGHT, VOLUME_BARS = 25.0, 30.0, 70.0, 20


def seasonal(date: Column, weekdays: bool = False) -> Column:
    """1, -1 or 0 by month; with weekdays only where month and weekday agree."""
    month = F.when(F.month(date).isin(*FALLING_MONTHS), -1).when(F.month(date).isin(*RISING_MONTHS), 1).otherwise(0)
    if not weekdays:
        return month
    day = F.when(F.weekday(date).isin(*FALLING_DAYS), -1).when(F.weekday(date).isin(*RISING_DAYS), 1).otherwise(0)
    return F.when((month != 0) & (month == day), month).otherwise(0)


def pair(panel: DataFrame, a: str, b: str, n: int = 60, entry: float = 2.0, code: str = "code", date: str = "date") -> DataFrame:
    """date, z, signal_a, signal_b on dates with both codes: half long the cheap and half short the dear one where the price ratio is more than `entry` deviations off its mean of n dates, else 0."""
    price = lambda c: F.max(F.when(F.col(code) == c, F.col("close")))
    both = panel.where(F.col(code).isin(a, b)).groupBy(date).agg(price(a).alias("_a"), price(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    w = W.orderBy(date).rowsBetween(1 - n, 0)  # a row a date
    r = F.col("_r")
    p = both.withColumn("_r", F.try_divide("_a", "_b"))
    p = p.withColumn("z", F.when(F.count(r).over(w) == n, F.try_divide(r - F.avg(r).over(w), F.stddev_samp(r).over(w))))
    side = F.when(F.col("z") < -entry, 0.5).when(F.col("z") > entry, -0.5).otherwise(0.0)
    return p.select(date, "z", side.alias("signal_a"), (-side).alias("signal_b"))


def vote(panel: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """code, date, vote: 1 where a rising trend (exponential means of 12 and 26 bars, trend strength above 25) or an oversold close (below the band, strength index below 30) comes with volume, and the close isn't overbought; -1 the other way."""
    volume = indicators.obv()["obv"]
    exprs = {"_fast": X.sma(col("close"), 13, 2), "_slow": X.sma(col("close"), 27, 2), "_volume": volume, "_mean": X.ts_mean(volume, VOLUME_BARS)} | {f"_{k}": e for k, e in indicators.bollinger().items()}
    p = Compiler(exprs, code, date).apply(panel, ("close",)).select(code, date, "close", *exprs).join(indicators.recursive(panel, 14, code, date).select(code, date, "rsi", "adx"), [code, date])
    is_true = lambda rule: F.coalesce(rule, F.lit(False))
    c, fast, slow = F.col("close"), F.col("_fast"), F.col("_slow")
    strong = F.col("adx") > TREND
    low, high = is_true((c < F.col("_boll_low")) & (F.col("rsi") < OVERSOLD)), is_true((c > F.col("_boll_up")) & (F.col("rsi") > OVERBOUGHT))
    buy = (is_true((fast > slow) & strong) | low) & is_true(F.col("_volume") > F.col("_mean")) & ~high
    sell = (is_true((fast < slow) & strong) | high) & is_true(F.col("_volume") < F.col("_mean")) & ~low
    return p.select(code, date, (buy.cast("int") - sell.cast("int")).alias("vote"))


def ma_cross(bars: DataFrame, fast: int = 10, slow: int = 20, long_only: bool = True, code: str = "code", time: str = "ts", close: str = "close") -> DataFrame:
    """code, ts, close, fast, slow, action, position: a row per trade of crossing moving averages. fast over slow buys (covers before), under it sells, and goes short unless long_only. Windows need slow + 1 closes."""
    by = W.partitionBy(code).orderBy(time, close)
    d = bars.where(F.col(close).isNotNull()).select(F.col(code).alias("code"), F.col(time).alias("ts"), F.col(close).cast("double").alias("close"))
    by = W.partitionBy("code").orderBy("ts", "close")
    mean = lambda n, back=0: F.avg("close").over(by.rowsBetween(-(n - 1) - back, -back))
    d = d.withColumns({"fast": mean(fast), "slow": mean(slow), "_f": mean(fast, 1), "_s": mean(slow, 1), "_i": F.row_number().over(by)}).where(F.col("_i") > slow)
    side = F.when((F.col("fast") > F.col("slow")) & (F.col("_f") <= F.col("_s")), 1).when((F.col("fast") < F.col("slow")) & (F.col("_f") >= F.col("_s")), 0 if long_only else -1)
    d = d.withColumn("_side", side).where("_side IS NOT NULL").withColumn("_was", F.coalesce(F.lag("_side").over(by), F.lit(0)))
    way = lambda a, b: (F.col("_was") == a) & (F.col("_side") == b)
    action = F.when(way(0, 1), "buy").when(way(-1, 1), "cover,buy").when(way(1, 0), "sell").when(way(0, -1), "short").when(way(1, -1), "sell,short")
    return d.where("_side != _was").select("code", "ts", "close", "fast", "slow", action.alias("action"), F.col("_side").alias("position"))
