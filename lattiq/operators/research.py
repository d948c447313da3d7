"""Walk-forward research on panels: yearly folds, candidate grids, signals stacked by ridge, tail fits, tick structure. Windows over per-date sums; no date's rows are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import Expr, _rank, col
from .evaluation import _corr

#: Dates of a ridge fit, dates before the first one, and its penalty (fixed values).
RIDGE_DATES, RIDGE_WARMUP, RIDGE_PENALTY = 252, 252, 1.0


def year_folds(df: DataFrame, train: int = 3, test: int = 1, step: int = 1, date: str = "date") -> DataFrame:
    """fold, train_from, test_from, test_to: training runs up to test_from, testing up to test_to, both left open; folds whose test ends within the dates."""
    ends = df.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    months = lambda n: F.add_months("_first", n)
    last = F.greatest(F.floor((F.months_between("_last", "_first") - 12 * train) / (12 * step)), F.lit(-1)).cast("int")
    k = ends.where(last >= 0).select("_first", "_last", F.explode(F.sequence(F.lit(0), last)).alias("fold"))
    start = F.col("fold") * (12 * step)
    out = k.select("fold", months(start).alias("train_from"), months(start + 12 * train).alias("test_from"), months(start + 12 * (train + test)).alias("test_to"), "_last")
    return out.where("test_to <= _last").drop("_last")


def grid(fields: tuple[str, ...] = ("close", "volume"), windows: tuple[int, ...] = (5, 20)) -> dict[str, Expr]:
    """Candidates: each time-series operator, field and window; all of them compile to one job. Operators over the codes of a date keep the order, and so the rank correlation, and add no candidate."""
    ops = {"mean": lambda x, n: x / X.ts_mean(x, n) - 1, "std": X.ts_std, "delta": lambda x, n: x / X.delay(x, n) - 1, "max": lambda x, n: x / X.ts_max(x, n)}
    out = {}
    for name, op in ops.items():
        for f in fields:
            for n in windows:
                out[f"{name}_{f}_{n}"] = op(col(f), n)
    return out


def grid_scores(df: DataFrame, names: list[str], label: str, date: str = "date") -> DataFrame:
    """factor, ic_mean, icir, n_days: daily rank correlation of each candidate column with the label, in one aggregate per date."""
    known = {n: F.when(F.col(label).isNotNull(), F.col(n)) for n in names}
    ranked = df.select(date, _rank(F.col(label), date).alias("_y"), *(_rank(known[n], date).alias(n) for n in names))
    daily = ranked.groupBy(date).agg(*(_corr(n, "_y").alias(n) for n in names))
    long = daily.unpivot([date], names, "factor", "ic").where("ic IS NOT NULL")
    s = long.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("_s"), F.count(F.lit(1)).alias("n_days"))
    return s.select("factor", "ic_mean", F.try_divide("ic_mean", F.nullif("_s", F.lit(0.0))).alias("icir"), "n_days")


def stacked_ridge(df: DataFrame, a: str, b: str, label: str, window: int = RIDGE_DATES, warmup: int = RIDGE_WARMUP, penalty: float = RIDGE_PENALTY, date: str = "date", code: str = "code") -> DataFrame:
    """date, code, stacked: prediction of a ridge fit of the label on two signals over the dates before, features standardised; 0 before `warmup` dates or with fewer than 50 rows.

    A date's rows are summed to nine numbers, windows add them over dates, and the 2 x 2 system is solved in closed form. The label must be known at the next date.
    """
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(date, code, F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(label).alias("_y"))
    full = F.col("_y").isNotNull()
    part = lambda x: F.coalesce(F.sum(F.when(full, x)), F.lit(0.0))
    x, z, y = F.col("_a"), F.col("_b"), F.col("_y")
    sums = rows.groupBy(date).agg(F.count(F.when(full, 1)).alias("n"), part(x).alias("sa"), part(z).alias("sb"), part(y).alias("sy"), part(x * x).alias("saa"), part(z * z).alias("sbb"), part(x * z).alias("sab"), part(x * y).alias("say"), part(z * y).alias("sby"))
    ordered = W.orderBy(date)  # a row per date
    past = ordered.rowsBetween(-window, -1)
    s = sums.select(date, F.row_number().over(ordered).alias("_i"), *(F.sum(c).over(past).alias(c) for c in sums.columns if c != date))
    ma, mb, my = F.col("sa") / F.col("n"), F.col("sb") / F.col("n"), F.col("sy") / F.col("n")
    s = s.withColumns({"ma": ma, "mb": mb, "da": F.sqrt(F.greatest(F.col("saa") / F.col("n") - ma * ma, F.lit(0.0))) + 1e-9, "db": F.sqrt(F.greatest(F.col("sbb") / F.col("n") - mb * mb, F.lit(0.0))) + 1e-9, "my": my})
    n = F.col("n")
    p = (F.col("saa") - n * F.col("ma") ** 2) / F.col("da") ** 2 + penalty
    q = (F.col("sbb") - n * F.col("mb") ** 2) / F.col("db") ** 2 + penalty
    r = (F.col("sab") - n * F.col("ma") * F.col("mb")) / (F.col("da") * F.col("db"))
    u, v = (F.col("say") - n * F.col("ma") * F.col("my")) / F.col("da"), (F.col("sby") - n * F.col("mb") * F.col("my")) / F.col("db")
    fits = s.where((F.col("_i") > warmup) & (n >= 50)).select(date, "ma", "mb", "da", "db", ((q * u - r * v) / (p * q - r * r)).alias("wa"), ((p * v - r * u) / (p * q - r * r)).alias("wb"))
    both = rows.join(fits, date, "left")
    value = F.col("wa") * (x - F.col("ma")) / F.col("da") + F.col("wb") * (z - F.col("mb")) / F.col("db")
    return both.select(date, code, F.coalesce(value, F.lit(0.0)).alias("stacked"))


def gpd_fit(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """n, shape, scale: generalised Pareto fit of what exceeds the threshold, by the ratio of squared mean to mean square; NULL for fewer than ten values or a shape of 0.5 or more either way, where moments tell nothing."""
    over = F.col(value) - threshold
    s = df.where(over > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(over).alias("m"), F.avg(over * over).alias("q"))
    ratio = F.col("m") * F.col("m") / F.col("q")
    ok = (F.col("n") >= 10) & (F.abs(0.5 * (1 - ratio)) < 0.5)
    return s.select("n", F.when(ok, 0.5 * (1 - ratio)).alias("shape"), F.when(ok, 0.5 * F.col("m") * (1 + ratio)).alias("scale"))


def tick_structure(ticks: DataFrame, keys: list[str], order: tuple[str, ...], price: str = "price", volume: str = "volume", side: str = "side") -> DataFrame:
    """Per group of ticks (ten at least): volume_autocorr (lag 1), impact_intercept (log change of price on log volume), path_distance of scaled price and volume, median_step, buy_share."""
    by = W.partitionBy(*keys)
    w = by.orderBy(*order)
    p, v = F.col(price), F.col(volume)
    t = ticks.withColumns({"_step": p - F.lag(p).over(w), "_before": F.lag(v).over(w), "_p": (p - F.min(p).over(by)) / (F.max(p).over(by) - F.min(p).over(by) + 1e-12), "_v": (v - F.min(v).over(by)) / (F.max(v).over(by) - F.min(v).over(by) + 1e-12)})
    moved = (v > 0) & (F.abs("_step") > 1e-9)
    x, y = F.when(moved, F.ln(v)), F.when(moved, F.ln(F.abs("_step") + 1e-12))
    later = F.when(F.col("_before").isNotNull(), v)
    sa, sb = F.stddev_pop(later), F.stddev_pop("_before")
    slope = F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(x), F.lit(0.0)))
    found = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when((sa > 1e-9) & (sb > 1e-9), F.covar_pop(later, "_before") / (sa * sb)).otherwise(0.0).alias("volume_autocorr"),
        F.when(F.count(x) > 5, F.avg(y) - slope * F.avg(x)).otherwise(0.0).alias("impact_intercept"), (F.sqrt(F.sum((F.col("_p") - F.col("_v")) ** 2)) / F.count(F.lit(1))).alias("path_distance"),
        F.expr("percentile(abs(_step), 0.5)").alias("median_step"), F.when(F.sum(v) > 0, F.coalesce(F.sum(F.when(F.col(side) > 0, v)), F.lit(0.0)) / F.sum(v)).otherwise(0.0).alias("buy_share"),
    )
    return found.where("n >= 10")
