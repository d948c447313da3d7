"""Blends of signals by market state: weights and factor sets that only use what was known before the date they hold for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import _rank

#: Days of a state that weights look back over and need, and the least weight of either signal (fixed values).
BLEND_DAYS, BLEND_LEAST, BLEND_FLOOR = 252, 20, 0.15
#: Mean ICs whose sum is this or less cancel out: rank correlations are fractions of few codes, so sums that are exactly 0 happen, and show as rounding noise of either sign (fixed value).
BLEND_TIE = 1e-12
#: Days of a state that a factor needs in training, factors of a set below which all days count, weights of a factor's own state: good, middling, bad (fixed values).
STATE_DAYS, SET_LEAST, STATE_WEIGHTS = 10, 3, (1.0, 0.7, 0.3)
#: Days looked ahead for a tail, the fall that counts as one; what a predicted tail takes from the weight, and the least weight left (fixed values).
TAIL_AHEAD, TAIL_FALL, TAIL_COEFFICIENT, TAIL_FLOOR = 20, -0.08, 1.5, 0.3


def state_weights(ics: DataFrame, states: DataFrame, window: int = BLEND_DAYS, least: int = BLEND_LEAST, floor: float = BLEND_FLOOR, date: str = "date") -> DataFrame:
    """date, state, weight of the first signal, from ics (date, first, second) and states (date, state).

    The ICs of earlier dates of the same state count, of the last `window` dates: weight = first / (first + second) by their means, within floor and 1 - floor; 0.5 where there are fewer than `least` dates, the sum isn't
    positive (to BLEND_TIE, so that rounding doesn't decide it) or the first is 0. A date without a state counts as "osc".
    """
    s = ics.join(states, date, "left").select(date, "first", "second", F.coalesce("state", F.lit("osc")).alias("state"))
    s = s.withColumn("_i", F.row_number().over(W.orderBy(date)))  # a row a date
    w = W.partitionBy("state").orderBy("_i").rangeBetween(-(window - 1), -1)
    a, b = F.avg("first").over(w), F.avg("second").over(w)
    share = F.greatest(F.lit(floor), F.least(F.lit(1 - floor), F.try_divide(a, a + b)))
    fine = (F.count(F.lit(1)).over(w) >= least) & (a + b > BLEND_TIE) & (F.abs(a) > 1e-9)
    return s.select(date, "state", F.when(fine, share).otherwise(0.5).alias("weight"))


def state_blend(df: DataFrame, first: str, second: str, weights: DataFrame, date: str = "date") -> DataFrame:
    """df with `blended`: percentile ranks of two signals by the date's weight; dates without one take both alike."""
    w = weights.select(date, "weight")
    d = df.withColumns({"_a": _rank(F.col(first), date), "_b": _rank(F.col(second), date)}).join(w, date, "left")
    weight = F.coalesce("weight", F.lit(0.5))
    return d.withColumn("blended", weight * F.col("_a") + (1 - weight) * F.col("_b")).select(*df.columns, "blended")


def state_factor_sets(ics: DataFrame, states: DataFrame, train: int = 250, test: int = 250, gap: int = 5, date: str = "date") -> DataFrame:
    """fold, state, factor, orient, weight: of each walk-forward fold (train dates, a gap, test dates, step by test dates), the factors to use in the test and their weights, from ics (date, factor, ic).

    state is that of the last training date. Factors with a positive mean IC on the training dates of that state (STATE_DAYS at least) are taken; if they are under SET_LEAST, those of a positive mean over all training dates
    too. Without any, factors of positive mean and IR. weight is the yearly IR of all training dates, 1 where it can't be taken; orient its sign. An IC must be known on its date.
    """
    days = ics.select(date).distinct().select(date, F.row_number().over(W.orderBy(date)).alias("_i"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n")).join(states, date, "left")
    last = F.floor((F.col("_n") - train - gap - test) / test)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("_i") - train) / test)), F.least(last, F.floor((F.col("_i") - 1) / test))
    dealt = days.where((last >= 0) & (low <= high)).select(date, "state", "_i", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("fold"))
    now = dealt.groupBy("fold").agg(F.max_by("state", "_i").alias("now"))
    d = ics.join(F.broadcast(dealt.join(now, "fold")), date)
    same = F.when(F.col("state") == F.col("now"), F.col("ic"))
    s = d.groupBy("fold", "now", "factor").agg(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n"), F.avg(same).alias("ms"), F.count(same).alias("ns"))
    picked = F.coalesce((F.col("ns") >= STATE_DAYS) & (F.col("ms") > 0), F.lit(False))
    wide = F.coalesce((F.col("n") >= STATE_DAYS) & (F.col("m") > 0), F.lit(False))
    of = W.partitionBy("fold")
    few = F.count(F.when(picked, 1)).over(of) < SET_LEAST
    s = s.withColumn("_in", picked | (few & wide))
    steady = F.coalesce(F.col("s") > 1e-9, F.lit(False))
    rest = steady & (F.col("m") > 0)
    s = s.withColumn("_any", F.max(F.col("_in").cast("int")).over(of)).where(F.when(F.col("_any") == 1, F.col("_in")).otherwise(rest))
    return s.select("fold", F.col("now").alias("state"), "factor", F.when(steady & (F.col("m") < 0), -1.0).otherwise(1.0).alias("orient"), F.when(steady, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(1.0).alias("weight"))


def state_signal(values: DataFrame, sets: DataFrame, factor_states: DataFrame | None = None, train: int = 250, test: int = 250, gap: int = 5, date: str = "date", code: str = "code") -> DataFrame:
    """date, code, fold, signal on the test dates: values (date, code, factor, value) by the weights of the fold. factor_states (date, factor, label of 1, 0 or -1): a factor's own state on the date scales its weight."""
    days = values.select(date).distinct().select(date, F.row_number().over(W.orderBy(date)).alias("_i"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    fold = F.floor((F.col("_i") - 1 - train - gap) / test).cast("int")
    # the last fold's test dates must be all there
    folds = days.where((F.col("_i") > train + gap) & (train + gap + (fold + 1) * test <= F.col("_n"))).select(date, fold.alias("fold"))
    d = values.join(F.broadcast(folds), date).join(F.broadcast(sets.select("fold", "factor", "orient", "weight")), ["fold", "factor"])
    weight = F.col("orient") * F.col("weight")
    if factor_states is None:
        total = F.sum("weight")
    else:
        d = d.join(factor_states.select(date, "factor", "label"), [date, "factor"], "left")
        good, middling, bad = STATE_WEIGHTS
        weight = weight * F.when(F.col("label") == 1, good).when(F.col("label") == -1, bad).otherwise(middling)
        total = F.sum(F.abs(weight))
    return d.groupBy(date, code, "fold").agg(F.try_divide(F.sum(weight * F.col("value")), total).alias("signal"))


def tail_labels(df: DataFrame, level: str, ahead: int = TAIL_AHEAD, fall: float = TAIL_FALL, series: list[str] | None = None, date: str = "date") -> DataFrame:
    """df with worst (the deepest fall from the row's level to one of the next `ahead` rows, its own included) and tail (1 if that is below `fall`), and known: whether all rows ahead are there. A model of date t may learn from
    rows only whose `ahead` rows lie before t."""
    by = W.partitionBy(*(series or [])).orderBy(date)
    ahead_of = by.rowsBetween(0, ahead - 1)
    d = df.withColumn("worst", F.try_divide(F.min(level).over(ahead_of), F.col(level)) - 1)
    return d.withColumns({"tail": (F.col("worst") < fall).cast("int"), "known": F.count(F.lit(1)).over(ahead_of) == ahead})


def gate_weight(probability: Column, severity: Column | None = None, coefficient: float = TAIL_COEFFICIENT, floor: float = TAIL_FLOOR) -> Column:
    """What a position keeps under a predicted tail: 1 - coefficient * probability * severity, within floor and 1; 1 without a prediction."""
    cut = 1 - F.lit(coefficient) * probability * (F.lit(1.0) if severity is None else severity)
    return F.coalesce(F.greatest(F.lit(floor), F.least(F.lit(1.0), cut)), F.lit(1.0))
