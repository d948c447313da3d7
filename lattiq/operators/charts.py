"""Chart patterns: turning points of series by centred windows, and the shapes that turning points in a row form. All are windows over (code, date), so a panel is shuffled once; later steps run over turning points alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Shoulders' and twin points' largest distance over their mean; flat slope and distance of price levels over the range (fixed values).
SHOULDERS, TWINS, FLAT, LEVEL = 0.05, 0.03, 0.02, 0.05
#: Bounds of the retracements of impulse waves 2, 3 and 4, and of waves B and C of a correction (fixed values).
IMPULSE, CORRECTION = ((0.5, 0.618), (1.0, 2.618), (0.236, 0.5)), ((0.382, 0.618), (0.618, 1.618))
#: Bounds of AB over XA and of AD over XA (fixed values); the first that fits names the shape.
HARMONIC = {"Gartley": ((0.55, 0.68), (0.72, 0.84)), "Bat": ((0.33, 0.55), (0.82, 0.94)), "Butterfly": ((0.72, 0.84), (1.20, 1.38)), "Crab": ((0.33, 0.68), (1.52, 1.72))}


def turning_points(panel: DataFrame, window: int = 10, high: str = "close", low: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """code, date, kind (`H` or `L`), price: bars with the largest (smallest) value among `window` bars on both sides. Bars nearer to an end have none; ties all count; a bar that is both gives two rows, missing prices none."""
    around = W.partitionBy(code).orderBy(date).rowsBetween(-window, window)
    p = panel.select(
        code, date, F.col(high).alias("_h"), F.col(low).alias("_l"), F.max(high).over(around).alias("_top"), F.min(low).over(around).alias("_bottom"), (F.count(F.lit(1)).over(around) == 2 * window + 1).alias("_full")
    )
    point = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.col(x).alias("price"))
    found = F.array_compact(F.array(F.when(F.col("_h") == F.col("_top"), point("H", "_h")), F.when(F.col("_l") == F.col("_bottom"), point("L", "_l"))))
    return p.where("_full").select(code, date, F.inline(found))


def head_and_shoulders(points: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """code, date, price of the middle one of three peaks in a row that is the highest, the outer two within 5 % of their mean."""
    w = W.partitionBy(code).orderBy(date)
    p = points.where("kind = 'H'").withColumns({"_a": F.lag("price").over(w), "_b": F.lead("price").over(w)})
    mean = (F.col("_a") + F.col("_b")) / 2
    return p.where((F.col("price") > F.col("_a")) & (F.col("price") > F.col("_b")) & (mean != 0) & (F.try_divide(F.abs(F.col("_a") - F.col("_b")), mean) <= SHOULDERS)).select(code, date, "price")


def double_points(points: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """code, date, twin: 1 at a peak within 3 % of the peak before, -1 at such a valley; where both hold the peak wins."""
    before = F.lag("price").over(W.partitionBy(code, "kind").orderBy(date))
    p = points.withColumn("_a", before)
    mean = (F.col("price") + F.col("_a")) / 2
    near = p.where((mean != 0) & (F.try_divide(F.abs(F.col("price") - F.col("_a")), F.abs(mean)) < TWINS))
    return near.groupBy(code, date).agg(F.max(F.when(F.col("kind") == "H", 1).otherwise(-1)).alias("twin"))


def converging(panel: DataFrame, window: int = 20, price: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """code, date, triangle, broadening, for bars with `window` bars before them: triangle 1 where the window's valleys rise and its peaks are flat, -1 where peaks fall and valleys are flat; broadening 1 where every peak is higher and
    every valley lower than the one before. A window's peaks and valleys are judged by the neighbours inside it.

    Those neighbours lie inside the window, so a bar is a peak of every window or of none: slopes and orders are sliding aggregates over one flagged series.
    """
    side = max(2, window // 5)
    w = W.partitionBy(code).orderBy(date)
    around, sofar, inside = w.rowsBetween(-side, side), w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(side - window, -side)
    x = F.col(price)
    full = F.count(F.lit(1)).over(around) == 2 * side + 1
    p = panel.select(code, date, F.when(full & (x == F.max(x).over(around)), x).alias("_h"), F.when(full & (x == F.min(x).over(around)), x).alias("_l"), F.row_number().over(w).alias("_i"))
    before = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    p = p.withColumns({"_hk": F.count("_h").over(sofar), "_lk": F.count("_l").over(sofar), "_hp": before("_h"), "_lp": before("_l")})

    def shape(c: str, breaks: Column) -> dict[str, Column]:
        nth = F.when(F.col(c).isNotNull(), F.col(f"{c}k"))
        return {f"{c}_n": F.count(c).over(inside), f"{c}_slope": F.regr_slope(F.col(c), F.col(f"{c}k")).over(inside), f"{c}_first": F.min(nth).over(inside), f"{c}_broken": F.max(F.when(breaks, nth)).over(inside)}

    p = p.withColumns(shape("_h", F.col("_h") <= F.col("_hp")) | shape("_l", F.col("_l") >= F.col("_lp")) | {"_top": F.max("_h").over(inside), "_bottom": F.min("_l").over(inside)})
    enough = (F.col("_h_n") >= 2) & (F.col("_l_n") >= 2)
    spread = F.col("_top") - F.col("_bottom")
    flat = spread * FLAT
    up, down = (F.col("_l_slope") > flat) & (F.abs("_h_slope") < flat), (F.col("_h_slope") < -flat) & (F.abs("_l_slope") < flat)
    unbroken = lambda c: F.coalesce(F.col(f"{c}_broken") <= F.col(f"{c}_first"), F.lit(True))
    return p.where(F.col("_i") > window).select(
        code, date, F.when(enough & (spread != 0) & up, 1).when(enough & (spread != 0) & down, -1).otherwise(0).alias("triangle"), F.when(enough & unbroken("_h") & unbroken("_l"), 1).otherwise(0).alias("broadening")
    )


def zigzag(points: DataFrame, both: bool = False, code: str = "code", date: str = "date") -> DataFrame:
    """points with peaks and valleys taking turns: of neighbours of one kind the most extreme stays, the earliest of equal ones. Bars that are peak and valley go, or with `both` count as a peak and then a valley."""
    w = W.partitionBy(code).orderBy(date, "kind")
    p = points
    if not both:
        p = p.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(code, date))).where("_same = 1").drop("_same")
    p = p.withColumn("_turn", F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(True)).cast("int"))
    p = p.withColumn("_island", F.sum("_turn").over(w.rowsBetween(W.unboundedPreceding, 0)))
    signed = F.when(F.col("kind") == "H", F.col("price")).otherwise(-F.col("price"))
    best = F.row_number().over(W.partitionBy(code, "_island").orderBy(signed.desc(), date))
    return p.withColumn("_best", best).where("_best = 1").select(code, date, "kind", "price")


def _ahead(zig: DataFrame, n: int, code: str, date: str) -> DataFrame:
    """zig with _q0 to _qn (this price and the next ones, negated where this point is a peak), _d0 to _dn and _s, 1 for a start at a valley; rows without n successors go."""
    w = W.partitionBy(code).orderBy(date, "kind")
    s = F.when(F.col("kind") == "L", 1).otherwise(-1)
    cols = {"_s": s} | {f"_q{i}": (F.lead("price", i).over(w) if i else F.col("price")) * s for i in range(n + 1)} | {f"_d{i}": F.lead(date, i).over(w) if i else F.col(date) for i in range(n + 1)}
    return zig.withColumns(cols).where(F.col(f"_q{n}").isNotNull())


def _within(x: Column, bounds: tuple[float, float], tolerance: float) -> Column:
    return (x >= bounds[0] - tolerance) & (x <= bounds[1] + tolerance)


def waves(zig: DataFrame, tolerance: float = 0.15, least_days: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """code, date, wave (`impulse` or `abc`), signal, of five-wave impulses (wave 2 doesn't pass the start, 3 isn't the shortest, 4 stays clear of 1) and three-wave corrections that end at date; the signal is against the last wave."""
    q = lambda i: F.col(f"_q{i}")
    long_enough = lambda n: F.least(*(F.date_diff(f"_d{i + 1}", f"_d{i}") for i in range(n))) >= least_days
    out = lambda n, wave: (F.col(f"_d{n}").alias(date), F.lit(wave).alias("wave"), (-F.col("_s")).alias("signal"))
    w1, w2, w3, w4, w5 = q(1) - q(0), q(1) - q(2), q(3) - q(2), q(3) - q(4), q(5) - q(4)
    ratios = ((F.try_divide(w2, w1), IMPULSE[0]), (F.try_divide(w3, w1), IMPULSE[1]), (F.try_divide(w4, w3), IMPULSE[2]))
    rule = (w1 > 0) & (w3 > 0) & (w5 > 0) & (q(2) > q(0)) & ~((w3 < w1) & (w3 < w5)) & (q(4) > q(1)) & long_enough(5)
    for r, bounds in ratios:
        rule = rule & _within(r, bounds, tolerance)
    impulses = _ahead(zig, 5, code, date).where(rule).select(code, *out(5, "impulse"))
    rule = (w1 > 0) & (w2 > 0) & (w3 > 0) & (q(2) > q(0)) & long_enough(3) & _within(F.try_divide(w2, w1), CORRECTION[0], tolerance) & _within(F.try_divide(w3, w1), CORRECTION[1], tolerance)
    return impulses.unionByName(_ahead(zig, 3, code, date).where(rule).select(code, *out(3, "abc")))


def harmonics(zig: DataFrame, tolerance: float = 0.08, code: str = "code", date: str = "date") -> DataFrame:
    """code, date (of D), shape, direction (1 where X is a valley), price (of D), of five turning points in a row whose retracements fit a named shape."""
    xa, ab, bc, ad = (F.abs(F.col(f"_q{b}") - F.col(f"_q{a}")) for a, b in ((0, 1), (1, 2), (2, 3), (1, 4)))
    shape = F.lit(None).cast("string")
    for name, (b, d) in reversed(HARMONIC.items()):
        shape = F.when(_within(F.try_divide(ab, xa), b, tolerance) & _within(F.try_divide(ad, xa), d, tolerance), name).otherwise(shape)
    p = _ahead(zig, 4, code, date).withColumn("shape", shape).where((xa > 0) & (ab > 0) & (bc > 0) & F.col("shape").isNotNull())
    return p.select(code, F.col("_d4").alias(date), "shape", F.col("_s").alias("direction"), (F.col("_q4") * F.col("_s")).alias("price"))


def price_levels(points: DataFrame, levels: int = 3, code: str = "code") -> DataFrame:
    """code, kind (`H` resistance, `L` support), level, points: prices of turning points in ascending order join the running mean of the cluster before if within 5 % of their range; the `levels` largest clusters (of equal ones the higher
    level). A series with no more points than that keeps each.

    Equal prices are counted before; the clusters of a series depend on each other in order of price, so its distinct prices are one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("price")
        price, count = pdf["price"].to_numpy(), pdf["n"].to_numpy()
        if count.sum() <= levels:
            out = [(x, 1) for x, n in zip(price, count, strict=True) for _ in range(n)]
        else:
            near = (price[-1] - price[0]) * LEVEL if price[-1] > price[0] else 1.0
            out = [(price[0] * count[0], count[0])]
            for x, n in zip(price[1:], count[1:], strict=True):
                total, k = out[-1]
                for _ in range(n):  # equal prices may move the mean out of or into reach one by one
                    if abs(x - total / k) <= near:
                        total, k = total + x, k + 1
                        out[-1] = (total, k)
                    else:
                        total, k = x, 1
                        out.append((total, k))
            out = sorted(((t / k, k) for t, k in out), key=lambda c: (-c[1], -c[0]))[:levels]
        return pd.DataFrame({code: pdf[code].iloc[0], "kind": pdf["kind"].iloc[0], "level": [float(x) for x, _ in out], "points": [int(k) for _, k in out]})

    kind = points.schema[code].dataType.simpleString()
    counted = points.where("price IS NOT NULL").groupBy(code, "kind", "price").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(code, "kind").applyInPandas(run, f"{code} {kind}, kind string, level double, points long")
