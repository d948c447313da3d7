"""Information coefficients, life cycles and choices of many factors at once, period by period. Factors are rows here, so plans don't widen with their number, and nothing is decided on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import ALIVE_IC, ALIVE_IR, ALIVE_SHARE, DECAY_DAYS, _corr

#: Chains of themes that go together (fixed values).
CHAINS = {
    "value_momentum": ["value", "momentum", "volume"],
    "quality_growth": ["quality", "growth", "momentum"],
    "low_risk": ["volatility", "liquidity", "reversal"],
    "smart_money": ["microstructure", "volume", "momentum"],
    "contrarian": ["reversal", "sentiment", "volatility"],
    "fundamental": ["value", "quality", "leverage"],
}


def daily_ics(df: DataFrame, factors: list[str], label: str, date: str = "date", least: int = 5) -> DataFrame:
    """date, factor, ic, n: rank correlation of each factor with the label over the codes of a date that have both; dates with fewer than `least` are left out."""
    long = df.where(F.col(label).isNotNull()).unpivot([date, label], factors, "factor", "_f").where("_f IS NOT NULL")
    at = W.partitionBy(date, "factor")
    rank = lambda x: F.rank().over(at.orderBy(x)) + (F.count(F.lit(1)).over(W.partitionBy(date, "factor", x)) - 1) / 2
    ranked = long.select(date, "factor", rank("_f").alias("_f"), rank(label).alias("_y"))
    return ranked.groupBy(date, "factor").agg(_corr("_f", "_y").alias("ic"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & F.col("ic").isNotNull())


def rolling_lifecycles(ics: DataFrame, window: int = 60, date: str = "date") -> DataFrame:
    """date, factor, roll_mean, roll_ir, positive_share, state of each factor's daily ICs: evaluation.rolling_lifecycle for all factors in one job."""
    by = W.partitionBy("factor").orderBy(date)
    w = by.rowsBetween(-(window - 1), 0)
    full = F.count("ic").over(w) >= max(1, window // 3)
    mean, std = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    s = ics.select(date, "factor", F.when(full, mean).alias("roll_mean"), F.when(full, F.try_divide(mean, F.nullif(std, F.lit(0.0)))).alias("roll_ir"), F.when(full, F.avg((F.col("ic") > 1e-12).cast("double")).over(w)).alias("positive_share"))
    alive = (F.abs("roll_mean") >= ALIVE_IC) & (F.abs("roll_ir") >= ALIVE_IR) & (F.col("positive_share") >= ALIVE_SHARE)
    lately = F.max((F.abs("roll_mean") >= ALIVE_IC).cast("int")).over(by.rowsBetween(-(DECAY_DAYS - 1), 0)) == 1
    return s.withColumn("state", F.when(F.col("roll_mean").isNull(), "warming").when(alive, "alive").when(lately, "decaying").otherwise("dead"))


def lifecycles(states: DataFrame, date: str = "date") -> DataFrame:
    """A row per factor: state now, figures of the last date, alive_since (first date of the last unbroken run of alive ones), the highest IR and its first date."""
    by = W.partitionBy("factor")
    broken = F.max(F.when(F.col("state") != "alive", F.col(date))).over(by)
    s = states.withColumn("_since", F.when(broken.isNull() | (F.col(date) > broken), F.col(date)))
    last = F.max_by(F.struct("state", "roll_mean", "roll_ir", "positive_share"), date).alias("_l")
    out = s.groupBy("factor").agg(last, F.min("_since").alias("_since"), F.max("roll_ir").alias("peak_ir"), F.max_by(date, F.struct("roll_ir", -F.unix_date(date))).alias("_peak"))
    return out.select("factor", F.col("_l.state").alias("status"), F.when(F.col("_l.state") == "alive", F.col("_since")).alias("alive_since"), "_l.roll_mean", "_l.roll_ir", "_l.positive_share", "peak_ir", F.when(F.col("peak_ir").isNotNull(), F.col("_peak")).alias("peak_date"))


def as_of_ends(states: DataFrame, ends: DataFrame, wait: int = 0, date: str = "date") -> DataFrame:
    """period, factor and the columns of states: of each period's end (ends: date), the last state that lies `wait` or more of the factor's own dates before. A label that looks `wait` dates ahead is known by then."""
    by = W.partitionBy("factor").orderBy(date)
    known = states.withColumn("_known", F.lead(date, wait).over(by) if wait else F.col(date)).where("_known IS NOT NULL")
    known = known.withColumn("_next", F.lead("_known").over(by))
    e = ends.select(F.col(date).alias("period")).distinct()
    # every period meets one row of a factor: the dates between two known ones are a range
    met = known.join(F.broadcast(e), (F.col("period") >= F.col("_known")) & (F.col("_next").isNull() | (F.col("period") < F.col("_next"))))
    return met.select("period", *states.columns)


def _greedy(candidates: Column) -> Column:
    """Names of candidates (array of structs with factor and near, best first) that are near none taken before."""
    return F.aggregate(candidates, F.array().cast("array<string>"), lambda taken, x: F.when(F.arrays_overlap(taken, F.coalesce(x["near"], F.array().cast("array<string>"))), taken).otherwise(F.concat(taken, F.array(x["factor"]))))


def best_chain(themes: Column, chains: dict[str, list[str]] | None = None, preferred: str | None = None) -> Column:
    """Struct (chain, score): the chain of which the largest share of themes is covered, the first of equal ones; NULL and 0 if none is. A preferred chain is taken whatever it covers."""
    chains = chains or CHAINS
    if preferred in chains:
        chains = {preferred: chains[preferred]}
    some = [F.struct((F.size(F.array_intersect(themes, F.array(*map(F.lit, of)))) / len(of)).alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("chain")) for k, (name, of) in enumerate(chains.items())]
    best = F.array_max(F.array(*some))
    return F.struct(F.when((best["score"] > 0) | F.lit(preferred in chains), best["chain"]).alias("chain"), best["score"].alias("score"))


def periodic_selection(
    states: DataFrame, pairs: DataFrame, themes: DataFrame, ends: DataFrame, per_theme: int = 2, least_ir: float = 0.5, limit: float = 0.7, most: int = 8, wait: int = 0, preferred: str | None = None, date: str = "date"
) -> DataFrame:
    """A row per period: period, selected (best first), dropped, themes, chain, chain_score, n_alive, n_decaying, n_dead. Periods without a state have no row.

    states: of rolling_lifecycles; pairs: date, a, b, corr of rolling correlations, of which the last up to the period counts; themes: factor, themes (array). Of each theme the per_theme alive factors of the largest
    absolute IR of at least least_ir are candidates, of all candidates the `most` of the largest absolute IR; from the largest absolute IC down, a factor stays unless it correlates by limit or more with one that stays. All periods are
    decided in parallel, each in its own row: a fold over at most `most` candidates.
    """
    at = as_of_ends(states, ends, wait, date)
    counts = at.groupBy("period").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(f"n_{s}") for s in ("alive", "decaying", "dead")))
    ir, ic = F.abs("roll_ir"), F.abs("roll_mean")
    alive = at.where((F.col("state") == "alive") & (ir >= least_ir)).join(themes, "factor").withColumn("theme", F.explode("themes"))
    alive = alive.withColumn("_place", F.row_number().over(W.partitionBy("period", "theme").orderBy(ir.desc(), "factor"))).where(F.col("_place") <= per_theme)
    chosen = alive.groupBy("period", "factor").agg(F.max(ir).alias("ir"), F.max(ic).alias("ic"), F.collect_set("theme").alias("_themes"))
    covered = chosen.groupBy("period").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_themes")))).alias("themes"))
    chosen = chosen.withColumn("_rank", F.row_number().over(W.partitionBy("period").orderBy(F.col("ir").desc(), "factor"))).where(F.col("_rank") <= most)
    last = ends.select(F.col(date).alias("period")).distinct()
    both = pairs.select(F.col("a").alias("factor"), F.col("b").alias("other"), date, "corr").unionByName(pairs.select(F.col("b").alias("factor"), F.col("a").alias("other"), date, "corr"))
    by = W.partitionBy("factor", "other").orderBy(date)
    spans = both.withColumn("_next", F.lead(date).over(by)).where(F.abs("corr") >= limit)
    near = spans.join(F.broadcast(last), (F.col("period") >= F.col(date)) & (F.col("_next").isNull() | (F.col("period") < F.col("_next"))))
    near = near.groupBy("period", "factor").agg(F.collect_set("other").alias("near"))
    chosen = chosen.join(near, ["period", "factor"], "left")
    row = F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("ic"), F.col("factor"), F.col("near"))))
    found = chosen.groupBy("period").agg(row.alias("_c")).withColumn("selected", _greedy(F.col("_c")))
    found = found.select("period", "selected", F.array_except(F.transform("_c", lambda x: x["factor"]), "selected").alias("dropped"))
    none = F.array().cast("array<string>")
    out = counts.join(found, "period", "left").join(covered, "period", "left").withColumns({c: F.coalesce(c, none) for c in ("selected", "dropped", "themes")})
    chain = best_chain(F.col("themes"), None, preferred)
    return out.withColumn("_chain", chain).select("period", "selected", "dropped", "themes", F.col("_chain.chain").alias("chain"), F.col("_chain.score").alias("chain_score"), "n_alive", "n_decaying", "n_dead")


def suppressed(df: DataFrame, stress: str, safe: str | None = None, hold: int = 42, floor: float = 0.3, least: float = 0.01, series: list[str] | None = None, date: str = "date") -> DataFrame:
    """df with `cooled`: stress (0 to 1) that, once over `least`, keeps up for `hold` rows: where it is over `least` in these rows it is `floor` at least, until a row is safe (a boolean column). Only after those rows the
    next trigger counts. A null stress is none. Triggers are taken greedily by a fold over the places of stress of a series, everything else is windows.
    """
    series = series or []
    of = series or [F.lit(0).alias("_one")]
    names = series or ["_one"]
    d = df.select("*", *([] if series else of))
    by = W.partitionBy(*names).orderBy(date)
    on = F.coalesce(F.col(stress) > least, F.lit(False))
    d = d.withColumn("_i", F.row_number().over(by))
    places = d.where(on).groupBy(*names).agg(F.array_sort(F.collect_list("_i")).alias("_p"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate("_p", start, lambda a, i: F.when(i >= a["free"], F.struct((i + hold).alias("free"), F.concat(a["taken"], F.array(i)).alias("taken"))).otherwise(a))
    starts = places.select(*names, F.explode(taken["taken"]).alias("_i"), F.lit(True).alias("_start"))
    d = d.join(starts, [*names, "_i"], "left")
    d = d.withColumn("_from", F.max(F.when(F.col("_start"), F.col("_i"))).over(by.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*names, "_from").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    left = F.max(F.coalesce(F.col(safe), F.lit(False)).cast("int")).over(run) == 1 if safe else F.lit(False)
    cooled = F.when(on & F.col("_from").isNotNull() & (F.col("_i") < F.col("_from") + hold) & ~left, F.greatest(stress, F.lit(floor))).otherwise(F.coalesce(stress, F.lit(0.0)))
    return d.withColumn("cooled", cooled).select(*df.columns, "cooled")
