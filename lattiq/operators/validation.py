"""Statistical validation: false-discovery control in ranked parts of the p-values; resampling replayed in Arrow batches, many draws per task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Parts of the p-values' range that are ranked side by side (fixed value).
PARTS = 64


def benjamini_hochberg(df: DataFrame, p: str = "p_value") -> DataFrame:
    """df with q: the least false-discovery rate at which the row would be accepted. The table has a row per hypothesis; one without p counts, comes last and has q 1.

    Equal p-values share q, that of the last of them, so each is ranked once, in parts of the range; only a row per part is ordered in one place.
    """
    x = F.col("_p")
    counted = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_k"))
    bounds = counted.agg(F.percentile_approx("_p", [i / PARTS for i in range(1, PARTS)], 10_000).alias("_bounds"))
    placed = counted.crossJoin(F.broadcast(bounds)).select("_p", "_k", F.size(F.filter("_bounds", lambda b: b < x)).alias("_part"))
    upward, downward = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.sum("_k").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(upward), F.lit(0)).alias("_start"))
    inner = W.partitionBy("_part")
    i = F.col("_start") + F.sum("_k").over(inner.orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.join(F.broadcast(starts), "_part").crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))
    ranked = ranked.select("_part", "_p", F.least(F.lit(1.0), x * F.col("_all") / i).alias("_raw"))
    later = ranked.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.min("_least").over(downward).alias("_later"))
    within = F.min("_raw").over(inner.orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0))
    found = ranked.join(F.broadcast(later), "_part").select("_p", F.least(within, "_later").alias("_q"))
    return df.join(found, F.col(p) == x, "left").withColumn("q", F.coalesce("_q", F.lit(1.0))).drop("_p", "_q")


def _draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n, numPartitions=max(1, min(n // 64, 64)))


def bootstrap(spark: SparkSession, returns: list[float], draws: int = 1000, block: int = 1, seed: int = 42) -> DataFrame:
    """draw, mean, sharpe of resampled return series, in blocks of `block` bars. The series is a row per bar of one curve, so it fits in every task; each draw has its own seed."""
    r = np.asarray(returns, float)

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng((seed, int(i)))
                start = rng.integers(0, max(1, len(r) - block + 1), -(-len(r) // block))
                x = r[(start[:, None] + np.arange(block)).ravel()[: len(r)]]
                out.append((int(i), x.mean(), x.mean() / (x.std(ddof=1) + 1e-10) * 252**0.5))
            yield pd.DataFrame(out, columns=["draw", "mean", "sharpe"])

    return _draws(spark, draws).mapInPandas(run, "draw long, mean double, sharpe double")


def permutation(spark: SparkSession, signal: list[float], returns: list[float], draws: int = 1000, seed: int = 42) -> DataFrame:
    """draw, mean of signal * return under random order of the signal; draw -1 is the order as it is."""
    s, r = np.asarray(signal, float), np.asarray(returns, float)

    def run(batches):
        for pdf in batches:
            out = [(int(i), float((np.random.default_rng((seed, int(i))).permutation(s) * r).mean())) for i in pdf["id"]]
            yield pd.DataFrame(out, columns=["draw", "mean"])

    actual = spark.createDataFrame([(-1, float((s * r).mean()))], "draw long, mean double")
    return actual.unionByName(_draws(spark, draws).mapInPandas(run, "draw long, mean double"))


def p_value(found: DataFrame, value: str = "mean") -> DataFrame:
    """One row: share of draws at or above the actual value, with the usual +1."""
    actual = found.where("draw = -1").agg(F.max(value).alias("actual"))
    drawn = found.where("draw >= 0").join(F.broadcast(actual))  # one row
    s = drawn.groupBy("actual").agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col(value) >= F.col("actual")).cast("long")).alias("_k"))
    return s.select("actual", ((F.col("_k") + 1) / (F.col("_n") + 1)).alias("p_value"))


def walk_forward(df: DataFrame, value: str, at: str = "date", folds: int = 5) -> DataFrame:
    """fold, n, mean, sharpe of consecutive equal parts of a series in time order."""
    w = W.orderBy(at)
    cut = df.withColumn("fold", F.ntile(folds).over(w))
    return cut.groupBy("fold").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) / (F.stddev_samp(value) + 1e-10) * 252**0.5).alias("sharpe"))
