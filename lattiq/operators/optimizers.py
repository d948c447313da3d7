"""Portfolio weights: capped softmax weights as windows over a date's codes, and weights from covariances of a date's lookback as grouped maps over rebalancing dates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rounds of capping, of group raking, and of equal risk contributions (fixed values).
CAP_ROUNDS, RAKE_ROUNDS, PARITY_ROUNDS = 12, 40, 5


def capped_weights(panel: DataFrame, alpha: str, most: float = 0.05, temperature: float = 1.0, date: str = "date") -> DataFrame:
    """panel with weight: softmax of alpha over a date's codes, capped at `most` and scaled back to 1 in turns; a missing alpha has no weight. All rounds share one shuffle, by date."""
    day = W.partitionBy(date)
    a = F.col(alpha) * temperature
    out = panel.withColumn("weight", F.exp(a - F.max(a).over(day)))
    for _ in range(CAP_ROUNDS):
        share = F.col("weight") / F.sum("weight").over(day)
        out = out.withColumn("weight", F.when(share > most, most).otherwise(share))
    return out.withColumn("weight", F.col("weight") / F.sum("weight").over(day))


def shrink_turnover(weighted: DataFrame, before: str, limit: float, weight: str = "weight", date: str = "date") -> DataFrame:
    """weighted with weights moved only so far from `before` that a date's summed changes stay within the limit, scaled to 1."""
    day = W.partitionBy(date)
    w, old = F.coalesce(F.col(weight), F.lit(0.0)), F.coalesce(F.col(before), F.lit(0.0))
    moved = F.sum(F.abs(w - old)).over(day)
    keep = F.when(moved > 1e-12, F.greatest(F.lit(0.0), 1 - limit / moved)).otherwise(0.0)
    out = weighted.withColumn("_w", F.greatest(w * (1 - keep) + old * keep, F.lit(0.0)))
    return out.withColumn(weight, F.col("_w") / (F.sum("_w").over(day) + 1e-12)).drop("_w")


def grouped_weights(panel: DataFrame, alpha: str, group: str, size: str | None = None, most: float = 0.05, code: str = "code", date: str = "date") -> DataFrame:
    """date, code, weight: capped softmax weights raked until each group has its share by size, or an equal one without `size`. A date's codes are one group: the universe bounds it."""

    def cap(w: np.ndarray) -> np.ndarray:
        w = np.clip(w, 0.0, None)
        for _ in range(CAP_ROUNDS):
            w = np.minimum(w / w.sum(), most)
        return w / w.sum()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(code)
        a = pdf["_a"].to_numpy(float)
        w = cap(np.exp(a - a.max()))
        names, at = np.unique(pdf["_g"].to_numpy(), return_inverse=True)
        if len(names) > 1:
            held = np.where(pdf["_s"].to_numpy(float) > 0, pdf["_s"].to_numpy(float), 0.0)
            share = np.bincount(at, held) / (held.sum() + 1e-12)
            if size is None:
                share = np.full(len(names), 1 / len(names))
            for _ in range(RAKE_ROUNDS):
                w = cap(w * (share / np.maximum(np.bincount(at, w), 1e-12))[at])
                if np.abs(np.bincount(at, w) - share).max() < 1e-3:
                    break
        return pd.DataFrame({date: pdf[date], code: pdf[code], "weight": w})

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    rows = panel.where(F.col(alpha).isNotNull()).select(date, code, F.col(alpha).cast("double").alias("_a"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_g"), (F.coalesce(F.col(size).cast("double"), F.lit(0.0)) if size else F.lit(1.0)).alias("_s"))
    return rows.groupBy(date).applyInPandas(run, f"{date} {kinds[date]}, {code} {kinds[code]}, weight double")


def lookback_groups(panel: DataFrame, value: str, lookback: int = 60, every: int = 20, code: str = "code", date: str = "date") -> DataFrame:
    """_at (a rebalancing date: every `every`-th of the dates, the first after a full lookback), date, code, value of the `lookback` dates that end there. A row goes to at most lookback / every of them, rounded up."""
    n = F.row_number().over(W.orderBy(date))  # a row a date
    days = panel.select(date).distinct().withColumn("_i", n - 1)
    ends = days.where((F.col("_i") >= lookback) & ((F.col("_i") - lookback) % every == 0)).select(F.col("_i").alias("_end"), F.col(date).alias("_at"))
    first = F.greatest(F.lit(lookback), F.ceil((F.col("_i") - lookback) / every) * every + lookback)
    last = F.col("_i") + lookback - 1
    rows = panel.select(date, code, F.col(value).alias("_v")).join(days, date)
    rows = rows.where(first <= last).withColumn("_end", F.explode(F.sequence(first.cast("int"), last.cast("int"), F.lit(every))))
    return rows.join(ends, "_end").select("_at", date, code, "_v")


def equal_risk(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weights after five rounds towards equal risk contributions, from inverse volatilities; a negative contribution makes a weight below 0."""
    vol = np.sqrt(np.diag(cov))
    if (vol < 1e-12).any():
        return np.full(len(vol), 1 / len(vol))
    w = 1 / vol / (1 / vol).sum()
    for _ in range(PARITY_ROUNDS):
        risk = np.sqrt(w @ cov @ w)
        if risk < 1e-12:
            break
        w = w * (risk / len(w) / (w * (cov @ w) / risk + 1e-12))
        w = w / w.sum()
    return w


def _best_ratio(gain: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Weights of 0 or more, summing to 1, with the largest w.gain / sqrt(w.cov.w), by coordinate descent on the equal problem min y.cov.y / 2 - gain.y; equal weights if nothing gains."""
    n = len(gain)
    even = np.full(n, 1 / n)
    spread = np.diag(cov)
    if (spread < 1e-24).any():
        return even
    y = np.zeros(n)
    slope = -gain.astype(float)  # of the target at y
    for _ in range(2000):
        moved = 0.0
        for i in range(n):
            new = max(0.0, y[i] - slope[i] / spread[i])
            if new != y[i]:
                slope += cov[i] * (new - y[i])
                moved, y[i] = max(moved, abs(new - y[i]) * spread[i] ** 0.5), new
        if moved < 1e-12 * max(1.0, np.abs(y).max()):
            break
    return y / y.sum() if y.sum() > 0 else even


def best_sharpe(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return _best_ratio(mean, cov)


def most_diversified(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return _best_ratio(np.sqrt(np.diag(cov)), cov)


METHODS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"equal_risk": equal_risk, "best_sharpe": best_sharpe, "most_diversified": most_diversified}


def covariance_weights(panel: DataFrame, value: str, method: str = "equal_risk", lookback: int = 60, every: int = 20, code: str = "code", date: str = "date") -> DataFrame:
    """date, code, weight at rebalancing dates, from returns of codes with values on half of the lookback's dates at least; missing ones count as 0. A group is lookback x codes numbers, whatever the panel's length."""
    solve = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index=date, columns=code, values="_v").sort_index()
        x = x.loc[:, x.count() * 2 >= lookback].fillna(0.0)
        w = solve(x.to_numpy().mean(axis=0), np.atleast_2d(np.cov(x.to_numpy(), rowvar=False))) if x.shape[1] else []
        return pd.DataFrame({date: pdf["_at"].iloc[0], code: x.columns, "weight": w})

    kinds = {f.name: f.dataType.simpleString() for f in panel.schema}
    return lookback_groups(panel, value, lookback, every, code, date).groupBy("_at").applyInPandas(run, f"{date} {kinds[date]}, {code} {kinds[code]}, weight double")


def absorption(panel: DataFrame, value: str, lookback: int = 60, every: int = 1, least: int = 10, code: str = "code", date: str = "date") -> DataFrame:
    """date, absorption: the first principal component's share of the variance of codes with a value on every date of the lookback, if there are `least` of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index=date, columns=code, values="_v")
        x = x.loc[:, x.notna().all()].to_numpy()
        share = None
        if len(x) == lookback and x.shape[1] >= least:
            s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
            share = float(s[0] / (s.sum() + 1e-12))
        return pd.DataFrame({date: [pdf["_at"].iloc[0]], "absorption": [share]})

    kind = panel.schema[date].dataType.simpleString()
    return lookback_groups(panel, value, lookback, every, code, date).groupBy("_at").applyInPandas(run, f"{date} {kind}, absorption double")


def scaled_signals(panel: DataFrame, signal: str, ret: str, n: int = 20, code: str = "code", date: str = "date") -> DataFrame:
    """panel with scaled: the signal times the code's share of the date's inverse volatilities (of the last n bars) and the number of codes that have one, clipped to [-1, 1]; codes without n returns have none."""
    w, day = W.partitionBy(code).orderBy(date).rowsBetween(1 - n, 0), W.partitionBy(date)
    p = panel.withColumn("_inverse", F.when(F.count(ret).over(w) == n, 1 / (F.stddev_samp(ret).over(w) + 1e-10)))
    share = F.col("_inverse") / F.sum("_inverse").over(day) * F.count("_inverse").over(day)
    return p.withColumn("scaled", F.when(F.col("_inverse").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(signal) * share)))).drop("_inverse")
