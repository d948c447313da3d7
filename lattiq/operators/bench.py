"""Benches of whole factor families in one job: IC of every factor, verdicts, and a strict variant with random controls and a later test period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import Compiler, Expr
from .evaluation import _corr


def long_table(panel: DataFrame, exprs: dict[str, Expr], label: Expr) -> DataFrame:
    """(date, code, factor, value, label) with a row per factor that has both; all factors are compiled as one batch and unpivoted in place."""
    wide = Compiler({**exprs, "label": label}).apply(panel)
    return wide.where("label IS NOT NULL").unpivot(["date", "code", "label"], list(exprs), "factor", "value").where("value IS NOT NULL")


def _pct(x: str, *keys: str) -> Column:
    at = W.partitionBy(*keys)
    return (F.rank().over(at.orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, x)) - 1) / 2) / F.count(F.lit(1)).over(at)


def daily_ics(long: DataFrame, least: int = 5) -> DataFrame:
    """(factor, date, ic). One shuffle by (factor, date) serves both ranks and the aggregate."""
    r = long.select("factor", "date", _pct("value", "factor", "date").alias("_f"), _pct("label", "factor", "date").alias("_y"))
    return r.groupBy("factor", "date").agg(_corr("_f", "_y").alias("ic"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= least) & F.col("ic").isNotNull()).drop("_n")


def t_stat(mean: Column, sd: Column, n: Column) -> Column:
    return F.when((sd > 0) & (n > 1), mean / (sd / F.sqrt(n)))


def bench(ics: DataFrame) -> DataFrame:
    """factor, ic_mean, ic_std, ir, positive_share, ic_count, category: alive (mean over 0.02, 55 % of days positive, |t| over 2), reversed (mean under -0.02, |t| over 2) or dead."""
    s = ics.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("ic_count"))
    t = F.coalesce(t_stat(F.col("ic_mean"), F.col("ic_std"), F.col("ic_count")), F.lit(0.0))
    s = s.withColumn("ir", F.when(F.col("ic_std") > 0, F.col("ic_mean") / F.col("ic_std"))).withColumn("_t", t)
    category = F.when((F.col("ic_mean") > 0.02) & (F.col("positive_share") >= 0.55) & (F.abs("_t") > 2), "alive").when((F.col("ic_mean") < -0.02) & (F.abs("_t") > 2), "reversed").otherwise("dead")
    return s.withColumn("category", category).drop("_t")


def shuffled(long: DataFrame, seed: int) -> DataFrame:
    """long with the values of each factor and date dealt anew among its codes, by the order of a hash of seed, factor and code: the same deal on every run and cluster."""
    by_hash = W.partitionBy("factor", "date").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "factor", F.col("code").cast("string"), F.col("date").cast("string"))), "code")
    place = W.partitionBy("factor", "date")
    p = long.withColumn("_i", F.row_number().over(place.orderBy("code"))).withColumn("_h", F.row_number().over(by_hash))
    # the value at place _i goes to the code of hash place _i: both numberings share one partitioning
    right = p.select("factor", "date", F.col("_h").alias("_i"), F.col("value").alias("_new"))
    return p.join(right, ["factor", "date", "_i"]).select("date", "code", "factor", F.col("_new").alias("value"), "label")


def strict_bench(long: DataFrame, split: str, seeds: int = 3, threshold: float = 2.0, least_days: int = 30) -> DataFrame:
    """factor, t_full, t_train, t_test, ic_count, category of the signal's IC less the mean IC of its shuffled values, before and from the split date."""
    signal = daily_ics(long)
    random = None
    for seed in range(seeds):
        one = daily_ics(shuffled(long, seed))
        random = one if random is None else random.unionByName(one)
    control = random.groupBy("factor", "date").agg(F.avg("ic").alias("_r"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == seeds)
    a = signal.join(control, ["factor", "date"]).select("factor", "date", (F.col("ic") - F.col("_r")).alias("a"))
    test = F.col("date") >= F.lit(split).cast("date")

    def stats(name: str, kept: Column) -> list[Column]:
        x = F.when(kept, F.col("a"))
        return [t_stat(F.avg(x), F.stddev_samp(x), F.count(x)).alias(name)]

    s = a.groupBy("factor").agg(*stats("t_full", F.lit(True)), *stats("t_train", ~test), *stats("t_test", test), F.count(F.lit(1)).alias("ic_count"))
    full, later = F.coalesce("t_full", F.lit(0.0)), F.col("t_test")
    category = (
        F.when(F.col("ic_count") < least_days, "noise").when(full <= -threshold, "reversed_strict").when((full >= threshold) & (later.isNull() | (later >= threshold)), "confirmed_alive")
        .when((full >= threshold) & (later <= -threshold), "reversed_strict").when(full >= threshold, "train_only").otherwise("noise")
    )
    return s.withColumn("category", category)
