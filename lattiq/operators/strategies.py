"""Parts of strategies over long panels: successive cuts, strength of a signal, hedges, weights from past IC by fold, half-life, crosses, allocations by year, walk-forward trees."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days of a training window and of a test block, days looked back on for a peak (fixed values).
TRAIN_DAYS, TEST_DAYS, LOOKBACK = 120, 20, 252


def keep_chain(df: DataFrame, stages: list[str], keep: float = 0.5, label: str = "label", date: str = "date", code: str = "code") -> DataFrame:
    """(date, ret, n_held): of each date's codes every stage keeps the best share by its column (two at least, ties by code, codes without a value go), as long as three have one; the rest is held in equal parts. A missing label counts as 0; dates that keep under two codes are left out.

    All stages work within a date: one shuffle."""
    at = W.partitionBy(date)
    p = df.select(date, code, F.col(label).alias("_y"), *(F.col(s).alias(f"_s{i}") for i, s in enumerate(stages))).withColumn("_go", F.lit(True))
    for i in range(len(stages)):
        x = F.col(f"_s{i}")
        p = p.withColumn("_n", F.count(x).over(at)).withColumn("_go", F.col("_go") & (F.col("_n") >= 3))
        p = p.withColumn("_place", F.row_number().over(at.orderBy(x.desc_nulls_last(), code)))
        p = p.where(~F.col("_go") | (x.isNotNull() & (F.col("_place") <= F.greatest(F.lit(2), F.floor(F.col("_n") * F.lit(keep))))))
    return p.groupBy(date).agg(F.avg(F.coalesce("_y", F.lit(0.0))).alias("ret"), F.count(F.lit(1)).alias("n_held")).where("n_held >= 2")


def signal_strength(df: DataFrame, signal: str, share: float = 0.10, window: int = 252, least: int = 60, date: str = "date", code: str = "code") -> DataFrame:
    """(date, spread, scale): mean signal of the greatest tenth of codes (of all in the table) less that of the least tenth, and how far that is above its past in deviations, cut to 0..1."""
    n = df.agg(F.greatest(F.lit(1), F.floor(F.count_distinct(code) * F.lit(share))).alias("_k"))
    at = W.partitionBy(date)
    p = df.where(F.col(signal).isNotNull()).select(date, code, F.col(signal).alias("_s")).withColumn("_up", F.row_number().over(at.orderBy(F.col("_s").desc(), code))).withColumn("_down", F.row_number().over(at.orderBy("_s", code)))
    p = p.crossJoin(F.broadcast(n))  # one row
    s = p.groupBy(date).agg((F.avg(F.when(F.col("_up") <= F.col("_k"), F.col("_s"))) - F.avg(F.when(F.col("_down") <= F.col("_k"), F.col("_s")))).alias("spread"))
    w = W.orderBy(date).rowsBetween(1 - window, 0)  # a row per date
    x = F.col("spread")
    z = F.when(F.count(x).over(w) >= least, (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-9))
    return s.select(date, "spread", F.when(z.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))).alias("scale"))


def hedged(port: DataFrame, index: DataFrame, method: str = "ols", window: int = 60, least: int = 30, date: str = "date") -> DataFrame:
    """(date, ret, beta, net) of tables (date, ret): the portfolio less beta times the index (0 where it has no return). Beta is 1 (`subtract`), that of all dates (`ols`), or that of the last `window` (`rolling`; before the first one, the first one). Under `least` dates it is 0."""
    p = port.where("ret IS NOT NULL").select(date, "ret").join(index.select(date, F.col("ret").alias("_x")), date, "left").withColumn("_x", F.coalesce("_x", F.lit(0.0)))
    if method == "subtract":
        p = p.withColumn("beta", F.lit(1.0))
    elif method == "ols":
        one = p.agg(F.when(F.count(F.lit(1)) >= least, F.covar_samp("ret", "_x") / (F.var_pop("_x") + 1e-12)).otherwise(0.0).alias("beta"))
        p = p.crossJoin(F.broadcast(one))  # one row
    elif method == "rolling":
        order = W.orderBy(date)  # a row per date
        w = order.rowsBetween(1 - window, 0)
        own = F.when(F.count("_x").over(w) >= window, F.try_divide(F.covar_samp("ret", "_x").over(w), F.var_samp("_x").over(w)))
        p = p.withColumn("_own", own).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
        later = F.last("_own", ignorenulls=True).over(W.orderBy(F.desc(date)).rowsBetween(W.unboundedPreceding, 0))
        p = p.withColumn("beta", F.when(F.col("_n") >= least, F.coalesce(later, F.lit(0.0))).otherwise(0.0))
    else:
        raise ValueError(f"unknown method {method!r}")
    return p.select(date, "ret", "beta", (F.col("ret") - F.col("beta") * F.col("_x")).alias("net"))


def fold_weights(ics: DataFrame, dates: DataFrame, train: int = TRAIN_DAYS, test: int = TEST_DAYS, date: str = "date") -> DataFrame:
    """(factor, fold, turn, weight) for folds of `test` dates that follow `train` dates (a multiple of it): turn is the sign of the mean IC of all dates before the fold, weight the size of the yearly ratio of the training window, 0 without a deviation.

    `dates` holds (factor, date) of the values to weigh. IC is summed up by block of `test` dates once; folds are windows over the blocks' sums, so no date is read twice. A factor without any IC before a fold has no row there."""
    if train % test:
        raise ValueError("train has to be a multiple of test")
    seen = dates.select("factor", date).distinct()
    known = seen.join(ics, ["factor", date], "left").join(numbered(seen, test, date), date)
    grid = known.groupBy("factor", "fold").agg(F.count("ic").alias("_n"), F.sum("ic").alias("_s"), F.sum(F.col("ic") * F.col("ic")).alias("_q"))
    order = W.partitionBy("factor").orderBy("fold")
    past, window = order.rangeBetween(W.unboundedPreceding, -1), order.rangeBetween(-(train // test), -1)
    n, s, q = (F.sum(c).over(window) for c in ("_n", "_s", "_q"))
    n = F.nullif(n, F.lit(0))
    g = grid.select("factor", "fold", F.sum("_n").over(past).alias("_past"), F.sum("_s").over(past).alias("_all"), n.alias("_k"), (s / n).alias("_mean"), F.when(n > 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))).alias("_sd"))
    weight = F.when(F.col("_sd") > 1e-12, F.abs(F.col("_mean") / F.col("_sd")) * 252**0.5).otherwise(0.0)
    return g.where((F.col("fold") >= train // test) & (F.col("_past") > 0)).select("factor", "fold", F.when(F.col("_all") >= 0, 1.0).otherwise(-1.0).alias("turn"), weight.alias("weight"))


def numbered(dates: DataFrame, test: int = TEST_DAYS, date: str = "date") -> DataFrame:
    """(date, fold): the distinct dates in blocks of `test`, from 0."""
    return dates.select(date).distinct().select(date, F.floor((F.row_number().over(W.orderBy(date)) - 1) / test).cast("int").alias("fold"))  # a row per date


def fold_signal(long: DataFrame, weights: DataFrame, test: int = TEST_DAYS, date: str = "date", code: str = "code") -> DataFrame:
    """(date, code, signal): weighted mean of turned z-scores (over a date's codes) by the weights of the date's fold; NULL where a factor of the fold is missing. Equal weights where all are 0."""
    at = W.partitionBy("factor", date)
    z = (F.col("value") - F.avg("value").over(at)) / (F.stddev_pop("value").over(at) + 1e-9)
    p = long.select("factor", date, code, z.alias("_z")).join(numbered(long, test, date), date).join(weights, ["factor", "fold"])
    sums = weights.groupBy("fold").agg(F.sum("weight").alias("_all"), F.count(F.lit(1)).alias("_m"))
    s = p.groupBy("fold", date, code).agg(F.sum(F.col("_z") * F.col("turn") * F.col("weight")).alias("_w"), F.sum(F.col("_z") * F.col("turn")).alias("_e"), F.count("_z").alias("_n"))
    s = s.join(sums, "fold")
    mean = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(F.col("_e") / F.col("_m"))
    return s.select(date, code, F.when(F.col("_n") == F.col("_m"), mean).alias("signal"))


def half_life(ics: DataFrame, lookback: int = LOOKBACK, date: str = "date") -> DataFrame:
    """(factor, days): calendar days from the peak IC of the last `lookback` (the first, if several) to the first one of at most half of it; NULL where there is none or no peak above 0."""
    recent = ics.where("ic IS NOT NULL").withColumn("_i", F.row_number().over(W.partitionBy("factor").orderBy(F.col(date).desc()))).where(F.col("_i") <= lookback)
    own = W.partitionBy("factor")
    p = recent.withColumn("_peak", F.max("ic").over(own)).withColumn("_at", F.min(F.when(F.col("ic") == F.col("_peak"), F.col(date))).over(own))
    fallen = F.min(F.when((F.col("_peak") > 0) & (F.col(date) >= F.col("_at")) & (F.col("ic") <= F.col("_peak") / 2), F.col(date)))
    return p.groupBy("factor").agg(F.datediff(fallen, F.min("_at")).alias("days"))


def with_bars_since_cross(df: DataFrame, line: str, signal: str, code: str = "code", date: str = "date") -> DataFrame:
    """df with bars_since_cross: bars since the last bar before this one at which line rose to or above signal from below; since the first bar where there was none."""
    own = W.partitionBy(code).orderBy(date)
    p = df.withColumn("_i", F.row_number().over(own)).withColumn("_rises", (F.col(line) >= F.col(signal)) & (F.lag(line).over(own) < F.lag(signal).over(own)))
    last = F.max(F.when(F.col("_rises"), F.col("_i"))).over(own.rowsBetween(W.unboundedPreceding, -1))
    return p.withColumn("bars_since_cross", F.col("_i") - F.coalesce(last, F.lit(1))).drop("_i", "_rises")


def allocation_by_year(returns: DataFrame, weights: dict[str, float], date: str = "date") -> DataFrame:
    """(year, ret, volatility, max_fall, n): a fixed allocation over columns of returns (missing: 0), rebalanced every date; falls are counted from the year's start."""
    mixed = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()))
    p = returns.select(F.year(date).alias("year"), date, mixed.alias("_r"))
    run = W.partitionBy("year").orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("_e", F.exp(F.sum(F.log1p("_r")).over(run))).withColumn("_fall", F.col("_e") / F.greatest(F.lit(1.0), F.max("_e").over(run)) - 1)
    return p.groupBy("year").agg((F.exp(F.sum(F.log1p("_r"))) - 1).alias("ret"), (F.stddev_samp("_r") * 252**0.5).alias("volatility"), F.min("_fall").alias("max_fall"), F.count(F.lit(1)).alias("n"))


def walk_forward_trees(df: DataFrame, features: list[str], label: str, folds: DataFrame, trees: int = 80, depth: int = 3, rate: float = 0.1, least: int = 200, seed: int = 42, date: str = "date") -> DataFrame | None:
    """Rows of every fold's test dates with `fold` and `prediction` by boosted trees fitted on its training dates; folds as by `year_folds` (a handful of rows). Rows without a label or a feature are left out; folds with under `least` training rows too; None where none is left.

    Each fit is a job over the cluster; only the trees come back to the driver."""
    whole = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in [*features, label])))
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(whole)
    model = GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed)
    parts = []
    for f in folds.orderBy("fold").collect():
        day = F.col(date)
        train = rows.where((day >= f["train_from"]) & (day < f["test_from"]))
        if train.limit(least).count() < least:
            continue
        test = rows.where((day >= f["test_from"]) & (day < f["test_to"]))
        parts.append(model.fit(train).transform(test).drop("_x").withColumn("fold", F.lit(f["fold"])))
    return reduce(DataFrame.unionByName, parts) if parts else None
