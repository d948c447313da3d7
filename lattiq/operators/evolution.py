"""Search for factor formulas by evolution: a generation is one batch of expressions that share their sub-trees, compiled to one plan and scored in one query; formulas that no other beats in both steadiness and turnover go on."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as X
from ..functions.expr import Compiler, Expr
from .selection import daily_ics
from .steps import cut

#: Share of values that a formula must have, and the IC and turnover it must reach; others score WORST (fixed values).
COVERAGE, LEAST_IC, LEAST_TURNOVER, WORST = 0.8, 0.004, 0.001, (-1.0, 100.0)
SPANS = (3, 5, 10, 20)

_SERIES: list[Callable[[Expr, int], Expr]] = [X.ts_mean, X.ts_std, X.ts_max, X.ts_min, X.ts_rank, X.delay, X.ts_sum, X.decay_linear]
_DATE: list[Callable[[Expr], Expr]] = [X.rank, X.cs_zscore, X.sign, X.absolute]
_PAIR: list[Callable[[Expr, Expr], Expr]] = [lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b, X.safe_div]


def random_expr(columns: list[str], depth: int, rng: random.Random) -> Expr:
    """A formula of at most so many levels over the columns."""
    if depth <= 0 or rng.random() < 0.15:
        return X.col(rng.choice(columns))
    kind = rng.random()
    if kind < 0.45:
        return rng.choice(_SERIES)(random_expr(columns, depth - 1, rng), rng.choice(SPANS))
    if kind < 0.7:
        return rng.choice(_DATE)(random_expr(columns, depth - 1, rng))
    return rng.choice(_PAIR)(random_expr(columns, depth - 1, rng), random_expr(columns, depth - 1, rng))


def places(e: Expr, at: tuple[int, ...] = ()) -> list[tuple[tuple[int, ...], Expr]]:
    """Every sub-tree with its path from the top."""
    return [(at, e), *(p for k, a in enumerate(e.args) for p in places(a, (*at, k)))]


def put(e: Expr, at: tuple[int, ...], new: Expr) -> Expr:
    """e with the sub-tree at a path exchanged."""
    if not at:
        return new
    return Expr(e.op, tuple(put(a, at[1:], new) if k == at[0] else a for k, a in enumerate(e.args)), e.param)


def levels(e: Expr) -> int:
    return 1 + max((levels(a) for a in e.args), default=0)


def mutate(e: Expr, columns: list[str], depth: int, rng: random.Random) -> Expr:
    """A random sub-tree exchanged for a new one; no deeper than before or than depth."""
    at, _ = rng.choice(places(e))
    return put(e, at, random_expr(columns, max(0, depth - len(at)), rng))


def cross(a: Expr, b: Expr, depth: int, rng: random.Random) -> Expr:
    """a with one of its sub-trees exchanged for one of b's; a itself where that would be too deep."""
    child = put(a, rng.choice(places(a))[0], rng.choice(places(b))[1])
    return child if levels(child) <= depth + 1 else a


def text(e: Expr) -> str:
    if e.op == "col":
        return e.param[0]
    inside = [*map(text, e.args), *(f"{p:g}" for p in e.param)]
    return f"({inside[0]} {e.op} {inside[1]})" if e.op in "+-*/" and len(e.args) == 2 else f"{e.op}({', '.join(inside)})"


def fitness(panel: DataFrame, population: dict[str, Expr], label: Expr, date: str = "date", code: str = "code") -> DataFrame:
    """factor, icir, turnover, ic, coverage of each expression in one query. ic: mean daily rank correlation with the label, icir: that over its deviation, turnover: mean change of a code's percentile rank from one of its dates to the
    next. What has too few values, no IC or no turnover to speak of scores WORST."""
    f = Compiler(population | {"_label": label}, code, date).apply(panel)
    names = list(population)
    ics = daily_ics(f, names, "_label", date).groupBy("factor").agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("_s"))
    long = f.select(date, code, *(F.col(n).cast("double").alias(n) for n in names)).unpivot([date, code], names, "factor", "_v")
    there = long.where("_v IS NOT NULL")
    at = W.partitionBy(date, "factor")
    rank = (F.rank().over(at.orderBy("_v")) + (F.count(F.lit(1)).over(W.partitionBy(date, "factor", "_v")) - 1) / 2) / F.count(F.lit(1)).over(at)
    moved = there.select(date, code, "factor", rank.alias("_r")).withColumn("_d", F.abs(F.col("_r") - F.lag("_r").over(W.partitionBy("factor", code).orderBy(date))))
    moved = moved.groupBy("factor").agg(F.avg("_d").alias("_t"), F.count(F.lit(1)).alias("_n"))
    s = moved.crossJoin(f.agg(F.count(F.lit(1)).alias("_rows"))).join(ics, "factor", "left")  # a row per expression, and a single row
    coverage = F.try_divide("_n", "_rows")
    bad = (coverage < COVERAGE) | F.col("ic").isNull() | (F.abs("ic") < LEAST_IC) | F.col("_t").isNull() | (F.col("_t") < LEAST_TURNOVER) | F.coalesce(F.col("_s") <= 0, F.lit(True))
    return s.select("factor", F.when(bad, WORST[0]).otherwise(F.try_divide("ic", "_s")).alias("icir"), F.when(bad, WORST[1]).otherwise(F.col("_t")).alias("turnover"), F.coalesce("ic", F.lit(0.0)).alias("ic"), coverage.alias("coverage"))


def fronts(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """scores with `front`: whether no other row (of the same group) is as good in both icir (high) and turnover (low) and better in one. Windows over the distinct icir values, not pairs of rows."""
    keys = by or []
    best = scores.groupBy(*keys, "icir").agg(F.min("turnover").alias("_m"))
    best = best.withColumn("_above", F.min("_m").over(W.partitionBy(*keys).orderBy(F.desc("icir")).rowsBetween(W.unboundedPreceding, -1)))
    return scores.join(best, [*keys, "icir"]).withColumn("front", (F.col("turnover") == F.col("_m")) & (F.col("_above").isNull() | (F.col("turnover") < F.col("_above")))).select(*scores.columns, "front")


def evolve(panel: DataFrame, columns: list[str], label: Expr, size: int = 40, generations: int = 20, seed: int = 42, depth: int = 3, date: str = "date", code: str = "code") -> DataFrame:
    """generation, formula, icir, turnover, ic, coverage, front of every formula of every generation; the last generation's front is the result.

    Formulas on a generation's front stay; the rest of the next are crossed or mutated from ones drawn by tournament. The same seed gives the same formulas. A generation is one query whatever its size, formulas met before are not
    scored again, and a row per formula of the population comes to the driver, which only draws.
    """
    rng = random.Random(seed)
    panel = cut(panel.select(date, code, *dict.fromkeys([*columns, *(x.param[0] for _, x in places(label) if x.op == "col")])))
    population: dict[str, Expr] = {}
    while len(population) < size:
        e = random_expr(columns, depth, rng)
        population[text(e)] = e
    known: dict[str, tuple] = {}
    out = []
    for g in range(generations):
        new = {t: e for t, e in population.items() if t not in known}
        if new:
            names = {f"e{k}": t for k, t in enumerate(new)}
            for r in fitness(panel, {n: new[t] for n, t in names.items()}, label, date, code).collect():
                known[names[r.factor]] = (round(r.icir, 9), round(r.turnover, 9), r.ic, r.coverage)
            for t in new:
                known.setdefault(t, (*WORST, 0.0, 0.0))
        out += [(g, t, *known[t]) for t in population]
        better = lambda t: (-known[t][0], known[t][1], t)
        best, elite = None, []
        for t in sorted(population, key=better):  # from the steadiest down, each with less turnover than all before
            if best is None or known[t][1] < best:
                best = known[t][1]
                elite.append(t)
        listed = sorted(population, key=better)
        pick = lambda: population[min(rng.sample(listed, min(3, len(listed))), key=better)]  # noqa: B023, E731
        following = {t: population[t] for t in elite[: max(1, size // 2)]}
        tries = 0
        while len(following) < size:
            child = cross(pick(), pick(), depth, rng) if rng.random() < 0.6 else mutate(pick(), columns, depth, rng)
            tries += 1
            child = child if tries < 20 * size else random_expr(columns, depth, rng)
            following[text(child)] = child
        population = following
    scores = panel.sparkSession.createDataFrame(out, "generation int, formula string, icir double, turnover double, ic double, coverage double")
    return fronts(scores, ["generation"])
