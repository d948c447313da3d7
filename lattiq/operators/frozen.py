"""Sets of factors chosen before a date and followed after it: ordinal IC, scores on both sides of a split, blended signals, decay, portfolios of the top share, and sums by theme.

Factors are rows of one long table (factor, date, code, value, label), so that a shuffle by (factor, date) serves them all, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import _rank
from .evaluation import _corr

#: Days of the recent and of the base IC, the least of each, the share of the base below which a factor decays, and the share of decayed factors from which a set is chosen anew (fixed values).
RECENT_DAYS, BASE_DAYS, RECENT_LEAST, BASE_LEAST, DECAY_SHARE, RENEW_SHARE = 60, 250, 20, 60, 0.30, 0.40
#: Share of codes held, dates held, cost of one side (fixed values).
TOP_SHARE, HOLD_DATES, SIDE_COST = 0.30, 5, 0.001


def long_rows(wide: DataFrame, factors: list[str], label: str = "label", date: str = "date", code: str = "code") -> DataFrame:
    """(factor, date, code, value, label), missing values kept: places are counted before pairs are formed."""
    return wide.select(date, code, F.col(label).alias("label"), *factors).unpivot([date, code, "label"], factors, "factor", "value")


def _place(x: str, date: str, code: str) -> Column:
    order = W.partitionBy("factor", date).orderBy(F.col(x).asc_nulls_last(), code)
    return F.when(F.col(x).isNotNull(), F.row_number().over(order))


def ordinal_ics(long: DataFrame, least: int = 10, date: str = "date", code: str = "code") -> DataFrame:
    """(factor, date, ic): correlation of ordinal places (ties go by code) of value and label, counted over all codes, on those that have both; dates with under `least` of these are left out."""
    p = long.select("factor", date, _place("value", date, code).alias("_f"), _place("label", date, code).alias("_y"))
    pairs = F.count(F.when(F.col("_f").isNotNull() & F.col("_y").isNotNull(), 1))
    return p.groupBy("factor", date).agg(_corr("_f", "_y").alias("ic"), pairs.alias("_n")).where((F.col("_n") >= least) & F.col("ic").isNotNull()).drop("_n")


def split_scores(ics: DataFrame, split: str, date: str = "date") -> DataFrame:
    """factor, mean and ratio of its IC up to the split and from it on (the split's day counts on both sides), alive: both above 0 before it. A deviation of 0 gives a ratio of 0."""
    day, at = F.col(date), F.lit(split).cast("date")
    before, after = F.when(day <= at, F.col("ic")), F.when(day >= at, F.col("ic"))
    ratio = lambda x: F.when(F.stddev_samp(x) > 0, F.avg(x) / F.stddev_samp(x)).otherwise(0.0)
    s = ics.groupBy("factor").agg(F.avg(before).alias("before_ic"), ratio(before).alias("before_ir"), F.avg(after).alias("after_ic"), ratio(after).alias("after_ir"))
    return s.withColumn("alive", F.coalesce((F.col("before_ic") > 0) & (F.col("before_ir") > 0), F.lit(False)))


def blend(long: DataFrame, scores: DataFrame, equal: bool = False, date: str = "date", code: str = "code") -> DataFrame:
    """(date, code, signal): weighted mean of the alive factors' values (a missing one is 0) by the size of their ratio before the split, turned by the sign of their mean; equal weights on demand. Without an alive factor the table is empty."""
    weight = F.lit(1.0) if equal else F.abs("before_ir")
    chosen = scores.where("alive").select("factor", weight.alias("_w"), F.when(F.col("before_ic") >= 0, 1.0).otherwise(-1.0).alias("_turn"))
    total = chosen.agg(F.sum("_w").alias("_all"))
    sums = long.join(chosen, "factor").groupBy(date, code).agg(F.sum(F.col("_w") * F.col("_turn") * F.coalesce("value", F.lit(0.0))).alias("_sum"))
    out = sums.crossJoin(F.broadcast(total))  # one row
    return out.select(date, code, F.when(F.col("_all") > 0, F.col("_sum") / F.col("_all")).otherwise(F.col("_sum")).alias("signal"))


def decay(ics: DataFrame, date: str = "date") -> DataFrame:
    """factor, recent_ic (last 60 days with an IC, 20 at least), base_ic (250, 60), their ratio, decayed: recent below 0, or below 30 % of a base above 0."""
    n = F.row_number().over(W.partitionBy("factor").orderBy(F.col(date).desc()))
    part = lambda days: F.when(F.col("_n") <= days, F.col("ic"))
    mean = lambda days, least: F.when(F.count(part(days)) >= least, F.avg(part(days)))
    s = ics.withColumn("_n", n).where(F.col("_n") <= BASE_DAYS).groupBy("factor").agg(mean(RECENT_DAYS, RECENT_LEAST).alias("recent_ic"), mean(BASE_DAYS, BASE_LEAST).alias("base_ic"))
    recent, base = F.col("recent_ic"), F.col("base_ic")
    return s.withColumn("ratio", F.when(F.abs(base) > 1e-9, recent / base)).withColumn("decayed", F.coalesce(recent < 0, F.lit(False)) | F.coalesce((base > 0) & (recent < base * DECAY_SHARE), F.lit(False)))


def renewal(decayed: DataFrame) -> DataFrame:
    """One row: number of factors, share of decayed ones, whether the set is to be chosen anew."""
    s = decayed.agg(F.count(F.lit(1)).alias("n_factors"), F.coalesce(F.avg(F.col("decayed").cast("double")), F.lit(0.0)).alias("decayed_share"))
    return s.withColumn("renew", F.col("decayed_share") > RENEW_SHARE)


def top_share(df: DataFrame, signal: Column, label: str = "label", share: float = TOP_SHARE, hold: int = HOLD_DATES, cost: float = SIDE_COST, date: str = "date", code: str = "code") -> DataFrame:
    """(date, ret, n_held) on every `hold`-th date: mean label of the share of codes (3 at least) with the greatest signal, ties by code, less both sides' cost of that share. Dates with under 5 codes that have both are left out but counted."""
    nth = df.select(date).distinct().withColumn("_i", F.row_number().over(W.orderBy(date))).where((F.col("_i") - 1) % hold == 0).select(date)  # a row per date
    p = df.select(date, code, signal.alias("_s"), F.col(label).alias("_y")).where("_s IS NOT NULL AND _y IS NOT NULL").join(nth, date)
    at = W.partitionBy(date)
    p = p.withColumn("_k", F.greatest(F.lit(3), F.floor(F.count(F.lit(1)).over(at) * F.lit(share)))).withColumn("_n", F.count(F.lit(1)).over(at)).withColumn("_place", F.row_number().over(at.orderBy(F.col("_s").desc(), code)))
    return p.where("_n >= 5 AND _place <= _k").groupBy(date).agg((F.avg("_y") - share * 2 * cost).alias("ret"), F.count(F.lit(1)).alias("n_held"))


def by_chance(seed: int, date: str = "date", code: str = "code") -> Column:
    """A signal without content: a hash of seed, date and code, the same on every run and cluster."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(date).cast("string"), F.col(code).cast("string")))


def against(port: DataFrame, bench: DataFrame, chance: DataFrame, per_year: float = 252 / HOLD_DATES, date: str = "date") -> DataFrame:
    """One row for three tables of (date, ret): annual and total return, greatest fall and Sharpe ratio of the portfolio, Sharpe of the benchmark, of the excess over it and of the portfolio by chance."""
    p = port.select(date, F.col("ret").alias("_p")).join(bench.select(date, F.col("ret").alias("_b")), date, "full").join(chance.select(date, F.col("ret").alias("_c")), date, "full")
    run = W.orderBy(date).rowsBetween(W.unboundedPreceding, 0)  # a row per date
    p = p.withColumn("_e", F.exp(F.sum(F.log1p("_p")).over(run)))
    p = p.withColumn("_fall", F.col("_e") / F.max("_e").over(run) - 1).withColumn("_x", F.col("_p") - F.col("_b"))
    sharpe = lambda c: F.when(F.stddev_samp(c) > 1e-12, F.avg(c) / F.stddev_samp(c) * F.lit(per_year**0.5)).otherwise(0.0)
    return p.agg(
        sharpe("_p").alias("sharpe"), (F.pow(1 + F.avg("_p"), F.lit(per_year)) - 1).alias("annual"), (F.exp(F.sum(F.log1p("_p"))) - 1).alias("total"), F.min("_fall").alias("max_fall"),
        sharpe("_b").alias("bench_sharpe"), sharpe("_x").alias("excess_sharpe"), sharpe("_c").alias("chance_sharpe"),
    )


def coverage(wide: DataFrame, factors: list[str], date: str = "date", code: str = "code") -> DataFrame:
    """(factor, coverage): values that are there, of all pairs of a date and a code; rows that the panel lacks count as missing."""
    s = wide.agg(F.count_distinct(date).alias("_d"), F.count_distinct(code).alias("_c"), *(F.count(f).cast("double").alias(f) for f in factors))
    return s.unpivot(["_d", "_c"], factors, "factor", "_n").select("factor", F.try_divide("_n", F.col("_d") * F.col("_c")).alias("coverage"))


def horizon_scores(panel: DataFrame, factor: str, horizons: tuple[int, ...] = (5, 20, 60), price: str = "close", least: int = 20, days: int = 10, date: str = "date", code: str = "code") -> DataFrame:
    """(horizon, ic, icir, n): mean daily rank correlation of a factor with the return over so many rows ahead, over its deviation of all days (population). Ranks are taken before pairs are formed; dates need `least` pairs, horizons `days` days, else all are 0."""
    own = W.partitionBy(code).orderBy(date)
    p = panel.select(date, code, F.col(factor).alias("_f"), *((F.try_divide(F.lead(price, h).over(own), F.col(price)) - 1).alias(f"_h{h}") for h in horizons))
    r = p.select(date, _rank(F.col("_f"), date).alias("_f"), *(_rank(F.col(f"_h{h}"), date).alias(f"_h{h}") for h in horizons))
    pairs = lambda h: F.count(F.when(F.col("_f").isNotNull() & F.col(f"_h{h}").isNotNull(), 1))
    daily = r.groupBy(date).agg(*(F.when(pairs(h) >= least, _corr("_f", f"_h{h}")).alias(str(h)) for h in horizons))
    long = daily.unpivot([date], [f"`{h}`" for h in horizons], "horizon", "ic").groupBy(F.col("horizon").cast("int").alias("horizon")).agg(F.avg("ic").alias("_m"), F.stddev_pop("ic").alias("_s"), F.count("ic").alias("_n"))
    enough = F.col("_n") >= days
    return long.select("horizon", F.when(enough, F.col("_m")).otherwise(0.0).alias("ic"), F.when(enough & (F.col("_s") > 0), F.col("_m") / F.col("_s")).otherwise(0.0).alias("icir"), F.when(enough, F.col("_n")).otherwise(0).alias("n"))


# themes: a table (factor, themes) with an array of names; a factor without any is "uncategorised"


def _themed(df: DataFrame, themes: DataFrame, key: str = "factor", name: str = "theme") -> DataFrame:
    t = themes.select(F.col("factor").alias(key), "themes")
    known = F.when(F.size("themes") > 0, F.col("themes")).otherwise(F.array(F.lit("uncategorised")))
    return df.join(t, key, "left").withColumn(name, F.explode(known)).drop("themes")


def theme_counts(rows: DataFrame, themes: DataFrame, categories: tuple[str, ...] = ("alive", "reversed", "dead"), column: str = "category") -> DataFrame:
    """theme, a count of each category, count: factors of a bench by theme; a factor of several themes counts in each."""
    return _themed(rows, themes).groupBy("theme").agg(*(F.count(F.when(F.col(column) == c, 1)).alias(c) for c in categories), F.count(F.lit(1)).alias("count"))


def alive_by_theme(rows: DataFrame, themes: DataFrame, ratio: str = "ir", column: str = "category") -> DataFrame:
    """(theme, place, factor): alive factors of each theme, the greatest ratio in size first."""
    t = _themed(rows.where(F.col(column) == "alive"), themes)
    return t.select("theme", F.row_number().over(W.partitionBy("theme").orderBy(F.abs(F.col(ratio)).desc(), "factor")).alias("place"), "factor")


def theme_correlations(pairs: DataFrame, themes: DataFrame) -> DataFrame:
    """(theme_a, theme_b, corr): mean size of the correlations between the factors of two themes, from a table (a, b, corr) with each pair of different factors once."""
    both = pairs.select("a", "b", "corr").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")).where("a <> b AND corr IS NOT NULL")
    t = _themed(_themed(both, themes, "a", "theme_a"), themes, "b", "theme_b")
    return t.groupBy("theme_a", "theme_b").agg(F.avg(F.abs("corr")).alias("corr"))


def exit_reasons(trades: DataFrame, reason: str = "exit_reason", pnl: str = "pnl") -> DataFrame:
    """Trades and total profit by the reason of leaving."""
    return trades.groupBy(reason).agg(F.count(F.lit(1)).alias("n_trades"), F.sum(pnl).alias("total_pnl"))
