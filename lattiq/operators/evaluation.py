"""Factor evaluation: rank information coefficients, quantile portfolios, verdicts, turnover, life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import _rank

#: A factor is alive from these absolute means and IRs and this share of positive days on, and decaying if its mean was so within these days (fixed values).
ALIVE_IC, ALIVE_IR, ALIVE_SHARE, DECAY_DAYS = 0.015, 0.2, 0.45, 20


def _corr(x: str, y: str):
    """Pearson correlation of a group; NULL where one side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    sx, sy = F.stddev_samp(a), F.stddev_samp(b)
    return F.when((sx > 1e-13) & (sy > 1e-13), F.try_divide(F.covar_samp(a, b), sx * sy))


def daily_ic(df: DataFrame, factor: str, label: str, date: str = "date", least: int = 5) -> DataFrame:
    """date, ic, n: the rank correlation of factor and later return over the codes of a date that have both; dates with fewer than `least` are left out."""
    pairs = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(date, F.col(factor).alias("_f"), F.col(label).alias("_y"))
    ranked = pairs.select(date, _rank(F.col("_f"), date).alias("_f"), _rank(F.col("_y"), date).alias("_y"))
    return ranked.groupBy(date).agg(_corr("_f", "_y").alias("ic"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("ic").isNotNull())


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: ic_mean, ic_std, ir, t_stat, positive_share, n_days; and the verdict alive, reversed or dead."""
    s = ic.agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_share"), F.count(F.lit(1)).alias("n_days"))
    s = s.withColumn("ir", F.try_divide("ic_mean", F.nullif("ic_std", F.lit(0.0)))).withColumn("t_stat", F.try_divide("ic_mean", F.nullif(F.col("ic_std") / F.sqrt("n_days"), F.lit(0.0))))
    verdict = F.when((F.abs("t_stat") < 2) | F.col("t_stat").isNull(), "dead").when(F.col("ic_mean") > 0, "alive").otherwise("reversed")
    return s.withColumn("verdict", verdict)


def quantile_returns(df: DataFrame, factor: str, label: str, groups: int = 5, date: str = "date", code: str = "code") -> DataFrame:
    """date, grp (1: lowest factor), ret, n: equally weighted later return of each factor group; ties go by code, dates with fewer codes than groups are left out."""
    p = df.where(F.col(factor).isNotNull() & F.col(label).isNotNull()).select(date, code, F.col(factor).alias("_f"), F.col(label).alias("_y"))
    at = W.partitionBy(date)
    p = p.withColumn("_i", F.row_number().over(at.orderBy("_f", code))).withColumn("_n", F.count(F.lit(1)).over(at)).where(F.col("_n") >= groups)
    grp = F.floor((F.col("_i") - 1) * groups / F.col("_n")).cast("int") + 1
    return p.groupBy(date, grp.alias("grp")).agg(F.avg("_y").alias("ret"), F.count(F.lit(1)).alias("n"))


def long_short(groups: DataFrame, top: int, date: str = "date") -> DataFrame:
    """date, spread: return of the top group less that of the lowest."""
    return groups.groupBy(date).agg((F.max(F.when(F.col("grp") == top, F.col("ret"))) - F.max(F.when(F.col("grp") == 1, F.col("ret")))).alias("spread")).where("spread IS NOT NULL")


def rank_turnover(df: DataFrame, factor: str, date: str = "date", code: str = "code") -> DataFrame:
    """date, turnover: mean absolute change of the codes' percentile rank since their previous date."""
    r = df.where(F.col(factor).isNotNull()).select(date, code, _rank(F.col(factor), date).alias("_r"))
    r = r.withColumn("_d", F.abs(F.col("_r") - F.lag("_r").over(W.partitionBy(code).orderBy(date))))
    return r.groupBy(date).agg(F.avg("_d").alias("turnover")).where("turnover IS NOT NULL")


def rolling_lifecycle(ic: DataFrame, window: int = 60, date: str = "date") -> DataFrame:
    """Trailing mean, IR and positive share of a daily IC series (at least window // 3 days), and a state from them. The series has a row per date, which one task can order."""
    w = W.orderBy(date).rowsBetween(-(window - 1), 0)
    n = F.count("ic").over(w)
    mean, std, pos = F.avg("ic").over(w), F.stddev_samp("ic").over(w), F.avg((F.col("ic") > 1e-12).cast("double")).over(w)
    least = max(1, window // 3)
    s = ic.select(date, F.when(n >= least, mean).alias("roll_mean"), F.when(n >= least, F.try_divide(mean, F.nullif(std, F.lit(0.0)))).alias("roll_ir"), F.when(n >= least, pos).alias("positive_share"))
    alive = (F.abs("roll_mean") >= ALIVE_IC) & (F.abs("roll_ir") >= ALIVE_IR) & (F.col("positive_share") >= ALIVE_SHARE)
    lately = F.max((F.abs("roll_mean") >= ALIVE_IC).cast("int")).over(W.orderBy(date).rowsBetween(-(DECAY_DAYS - 1), 0)) == 1
    return s.withColumn("state", F.when(F.col("roll_mean").isNull(), "warming").when(alive, "alive").when(lately, "decaying").otherwise("dead"))


def lifecycle(states: DataFrame, date: str = "date") -> DataFrame:
    """One row from rolling_lifecycle: status now, alive_since and alive_days if alive, the latest figures, the highest IR and its first date."""
    last = F.max_by(F.struct("state", "roll_mean", "roll_ir", "positive_share"), date)
    broken = F.max(F.when(F.col("state") != "alive", F.col(date)))
    s = states.agg(last.alias("_l"), F.max(date).alias("_last"), broken.alias("_broken"), F.min(date).alias("_first"), F.max("roll_ir").alias("peak_ir"), F.max_by(date, F.struct("roll_ir", -F.unix_date(date))).alias("peak_date"), F.collect_set(date).alias("_days"))
    since = F.array_min(F.filter("_days", lambda d: d > F.coalesce(F.col("_broken"), F.date_sub("_first", 1))))
    alive = F.col("_l.state") == "alive"
    return s.select(F.col("_l.state").alias("status"), F.when(alive, since).alias("alive_since"), F.when(alive, F.datediff("_last", since)).alias("alive_days"), "_l.roll_mean", "_l.roll_ir", "_l.positive_share", "peak_ir", "peak_date")


def correlated_pairs(correlations: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of factor_correlation whose absolute correlation is `least` or more."""
    return correlations.where(F.abs("corr") >= least)


def select_factors(scores: DataFrame, correlations: DataFrame, most: int = 10, limit: float = 0.7) -> list[str]:
    """Names (factor, score) taken from the highest score down, leaving out each that correlates by `limit` or more with one taken; a table of factors is small and is decided on the driver."""
    near = {frozenset((r.a, r.b)) for r in correlated_pairs(correlations, limit).select("a", "b").collect()}
    taken: list[str] = []
    for r in scores.where("score IS NOT NULL").orderBy(F.desc("score"), "factor").collect():
        if len(taken) < most and all(frozenset((r.factor, t)) not in near for t in taken):
            taken.append(r.factor)
    return taken
