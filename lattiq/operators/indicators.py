"""Technical indicators: windows where they are finite, a grouped map per series where they recurse."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import Expr, col


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Expr]:
    mid, sd = X.ts_mean(col("close"), n), X.ts_std(col("close"), n)
    return {"boll_mid": mid, "boll_up": mid + sd * k, "boll_low": mid - sd * k}


def obv() -> dict[str, Expr]:
    return {"obv": X.cum_sum(X.fill(X.sign(X.delta(col("close"), 1)), 0) * col("volume"))}


def historical_volatility(n: int = 30) -> dict[str, Expr]:
    return {"hist_vol": X.ts_std(X.log(col("close") / X.delay(col("close"), 1)), n) * 252**0.5}


def regime() -> dict[str, Expr]:
    """bull 1, bear -1, other 0: by the 120-bar mean and the drop from the peak so far."""
    c, mean = col("close"), X.ts_mean(col("close"), 120)
    drop = c / X.cum_max(c) - 1
    return {"regime": X.where((c < mean) & (drop < -0.1), -1, X.where(c > mean, 1, 0))}


def recursive(panel: DataFrame, period: int = 14, code: str = "code", date: str = "date") -> DataFrame:
    """panel keys with rsi, adx, plus_di, minus_di (exponential means with weights normalised over what was seen) and macd, macd_signal (12, 26, 9, started by the first value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(date, kind="stable")
        c, h, low = p["close"], p["high"], p["low"]
        mean = lambda x: x.ewm(alpha=1 / period, min_periods=period).mean()
        step = c.diff()
        gain, loss = mean(step.clip(lower=0)), mean(-step.clip(upper=0))
        rsi = 100 - 100 / (1 + gain / loss.where(loss != 0))
        up, down = h.diff(), -low.diff()
        plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
        span = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
        atr = mean(span)
        pdi, mdi = 100 * mean(plus) / atr.where(atr != 0), 100 * mean(minus) / atr.where(atr != 0)
        total = pdi + mdi
        adx = mean(100 * (pdi - mdi).abs() / total.where(total != 0))
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        return pd.DataFrame({code: p[code], date: p[date], "rsi": rsi, "adx": adx, "plus_di": pdi, "minus_di": mdi, "macd": macd, "macd_signal": macd.ewm(span=9, adjust=False).mean()})

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    names = ("rsi", "adx", "plus_di", "minus_di", "macd", "macd_signal")
    out = panel.select(code, date, "close", "high", "low").groupBy(code).applyInPandas(run, f"{code} {kinds[code]}, {date} {kinds[date]}, " + ", ".join(f"{n} double" for n in names))
    return out.select(code, date, *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names))


def streaks(panel: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """Signed number of bars that the close has risen or fallen in a row, by islands of equal direction."""
    w = W.partitionBy(code).orderBy(date)
    p = panel.select(code, date, F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)).alias("_s"))
    p = p.withColumn("_new", (F.col("_s") != F.coalesce(F.lag("_s").over(w), F.lit(9.0))).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return p.select(code, date, (F.col("_s") * F.row_number().over(W.partitionBy(code, "_island").orderBy(date))).cast("int").alias("streak"))
