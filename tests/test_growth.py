"""Steps whose work grows with the rows and whose results don't depend on how rows are dealt."""

import datetime
import math
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.functions.expr import NUDGE, Compiler, digest
from lattiq.operators import blends, validation
from lattiq.plans import alpha101, intraday
from lattiq.plans.panel import bars


def dealt(spark, days=1, each=900):
    """The same ticks in several orders and numbers of partitions."""
    rng = np.random.default_rng(8)
    at = datetime.datetime(2024, 1, 1)
    sizes, paid = rng.integers(1, 51, (days, each)), rng.integers(10_000, 9_000_000, (days, each)) / 100
    rows = [(at + datetime.timedelta(days=d), "a", i, float(paid[d, i] / sizes[d, i]), float(sizes[d, i]) / 10) for d in range(days) for i in range(each)]
    for seed, parts in ((0, 1), (1, 1), (2, 3), (3, 7)):
        mixed = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))] if seed else rows
        yield rows, bars(spark.createDataFrame(mixed, "ts timestamp, code string, i int, price double, size double").repartition(parts, F.col("i") % parts), "day", ("i",)).withColumn("sector", F.lit(0))


def test_false_discovery_of_many_rows_ties_and_missing(spark):
    rng = np.random.default_rng(5)
    for p in ([0.04, None, 0.01, 0.04, 0.9, None, 0.02], [0.5] * 9, [None, None], [], [*rng.random(700).round(2), *rng.random(700) ** 4, 0.0, 1.0, 1.3]):
        rows = [(i, None if x is None else float(x)) for i, x in enumerate(p)]
        found = validation.benjamini_hochberg(spark.createDataFrame(rows, "name int, p_value double").repartition(3))
        # a frame that ends with the table is gone through again for every row
        assert found.columns == ["name", "p_value", "q"] and "unboundedfollowing$" not in found._jdf.queryExecution().toString()
        order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0.0, r[0]))
        want, least = {}, 1.0
        for place in range(len(order), 0, -1):
            name, x = order[place - 1]
            least = min(least, 1.0 if x is None else x * len(order) / place)
            want[name] = least
        assert {r["name"]: r["q"] for r in found.collect()} == want


def test_sums_of_bars_are_those_of_the_terms_in_any_order(spark):
    for rows, panel in dealt(spark):
        got = panel.first()
        assert got["amount"] == math.fsum(r[3] * r[4] for r in rows) and got["volume"] == math.fsum(r[4] for r in rows)
    odd = [(1, 2e17), (1, 0.1), (2, math.inf), (2, 1.0), (3, math.nan), (3, 1.0), (4, None), (5, 1e-9), (5, None), (6, -0.3), (6, 0.3)]
    ticks = spark.createDataFrame([(datetime.datetime(2024, 1, 1), k, x, 1.0) for k, x in odd], "ts timestamp, code int, price double, size double")
    got = {r["code"]: r["amount"] for r in bars(ticks).collect()}
    assert got[1] == 2e17 and got[2] == math.inf and (got[3] is None or math.isnan(got[3])) and got[4] is None and got[5] == 1e-9 and got[6] == 0


def test_alpha_041_is_the_same_in_any_order(spark):
    e = {"x": alpha101.alphas()["alpha_041"]}
    found = [sorted(tuple(r) for r in Compiler(e).apply(panel).collect()) for _, panel in dealt(spark, 6, 300)]
    assert len(found[0]) == 6 and all(f == found[0] for f in found)


def test_alpha_041_at_a_rounding_edge_is_the_exact_value(spark):
    paid = [(26688.78, 20.0), (28353.01, 35.0), (85606.39, 38.0), (79613.0, 44.0), (87471.72, 42.0), (52706.01, 45.0)] * 60
    price, size = np.array([p / q for p, q in paid]), np.array([q for _, q in paid])
    shown = lambda amount: float((root - Decimal(amount.numerator) / Decimal(amount.denominator) / Decimal(size.sum()) + Decimal(NUDGE)).quantize(Decimal("1e-6"), ROUND_HALF_UP))
    root, terms = (Decimal(price.max()) * Decimal(price.min())).sqrt(), price * size
    want = shown(sum(Fraction(float(x)) for x in terms))
    assert want == -258.190907 and shown(Fraction(float(np.cumsum(terms)[-1]))) == -258.190908  # one after the other, as doubles, rounding adds up
    ticks = spark.createDataFrame([(datetime.datetime(1996, 2, 1), "a", i, float(price[i]), float(size[i])) for i in range(len(paid))], "ts timestamp, code string, i int, price double, size double")
    e = {"x": alpha101.alphas()["alpha_041"]}
    for parts in (1, 3, 7):
        assert Compiler(e).apply(bars(ticks.repartition(parts, F.col("i") % parts), "day", ("i",))).select(digest("x")).first()["x"] == want


def test_state_weights_of_mean_ics_that_cancel_out_are_alike(spark):
    rng, seen, day = np.random.default_rng(4), {}, datetime.date(2024, 1, 1)
    for _ in range(200):  # rank correlations of 25 codes are whole numbers of 1/1300
        a = rng.integers(-600, 600, 33)
        b = rng.permutation(-a)
        total = np.cumsum(a / 1300)[-1] / 33 + np.cumsum(b / 1300)[-1] / 33
        if abs(a.sum()) > 100:
            seen.setdefault(np.sign(total), (a, b, total))
    assert set(seen) == {-1, 0, 1}
    states = spark.createDataFrame([(day + datetime.timedelta(days=i), "bull") for i in range(34)], "date date, state string")
    for more, want in ((0, (0.5, 0.5)), (1, (0.15, 0.85)), (-1, (0.5, 0.5))):  # a sum of exactly 0, one of 1/42900, one below 0
        for a, b, total in seen.values():
            assert abs(total) < 1e-15
            first = [*a[:-1], a[-1] + more, 0] if more else [*a, 0]
            ics = spark.createDataFrame([(day + datetime.timedelta(days=i), float(x) / 1300, float(y) / 1300) for i, (x, y) in enumerate(zip(first, [*b, 0], strict=True))], "date date, first double, second double")
            last = blends.state_weights(ics, states, 100).where(F.col("date") == day + datetime.timedelta(days=33)).first()
            assert last["weight"] == want[int(a.sum() > 0)]


def test_signals_are_blended_alike_where_mean_ics_cancel_out(spark):
    rng, day = np.random.default_rng(4), datetime.date(2024, 1, 1)
    for _ in range(200):  # about a third of these sums of 0 round up
        a = rng.integers(-600, 600, 33)
        b = rng.permutation(-a)
        if np.cumsum(a / 1300)[-1] / 33 + np.cumsum(b / 1300)[-1] / 33 > 0 and abs(a.sum()) > 100:
            break
    ics = spark.createDataFrame([(day + datetime.timedelta(days=i), float(x) / 1300, float(y) / 1300) for i, (x, y) in enumerate(zip([*a, 0], [*b, 0], strict=True))], "date date, first double, second double")
    weights = blends.state_weights(ics, ics.select("date", F.lit("bull").alias("state")), 100)
    rows = [(day + datetime.timedelta(days=33), c, float(x), float(y)) for c, x, y in (("a", 1, 8), ("b", 2, 7), ("c", 3, 9), ("d", 4, 6))]
    got = blends.state_blend(spark.createDataFrame(rows, "date date, code string, x double, y double"), "x", "y", weights).collect()
    assert {r["code"]: r["blended"] for r in got} == {"a": 0.5, "b": 0.5, "c": 0.875, "d": 0.625}


def test_day_shapes_in_blocks_equal_a_loop_over_the_day(spark):
    rng = np.random.default_rng(31)
    rows = []
    for day, n in enumerate((36, 37, 48, 64, 99, 128, 163, 300)):
        c, v = 10 * np.exp(rng.normal(size=n) * 0.01), rng.integers(1, 30, n).astype(float)
        v[120:170] = 7.0  # no regression while the volume rests
        rows += [(f"c{day}", datetime.date(2024, 1, 1), i, None if i % 41 == 40 else float(c[i]), None if i % 67 == 66 else float(v[i])) for i in range(n)]
    rows += [(None, None, i, float(10 + rng.random()), float(rng.integers(1, 30))) for i in range(90)]
    df = spark.createDataFrame(rows, "code string, date date, i int, close double, volume double").repartition(5)
    plain, blocks = ({r["code"]: r for r in intraday.day_shapes(df, ("i",), **k).collect()} for k in ({}, {"size": 64}))
    for code in {r[0] for r in rows}:
        c, v = (np.array([np.nan if r[k] is None else r[k] for r in rows if r[0] == code]) for k in (3, 4))
        r, dv, found = np.diff(np.log(c)), np.diff(v), []
        for last in range(36, len(r)):
            x = np.array([[1.0, *(dv[t - lag] for lag in range(6))] for t in range(last - 29, last + 1)])
            y = r[last - 29 : last + 1]
            good = np.isfinite(x).all(axis=1) & np.isfinite(y)
            x, y = x[good], y[good]
            if len(y) < 15 or x[:, 1].std() < 1e-15:
                continue
            b = np.linalg.lstsq(x, y, rcond=None)[0]
            error = np.sqrt(np.diag(np.linalg.pinv(x.T @ x + 1e-10 * np.eye(7))) * ((y - x @ b) ** 2).sum() / (len(y) - 7))
            found.append(b / np.where(error > 1e-15, error, 1.0))
        t = np.array(found)
        want = (t[:, 2:].std(axis=1).mean(), np.abs(t[:, 0]).mean(), t[:, 0].mean()) if len(t) >= 10 else (None, None, None)
        for got in (plain[code], blocks[code]):
            assert [got[k] for k in ("lag_spread", "level_size", "level")] == [w if w is None else pytest.approx(w, rel=1e-6, abs=1e-9) for w in want]
        assert plain[code]["ripple"] == blocks[code]["ripple"] and plain[code]["ripple"] is not None


def test_exact_fits_of_day_shapes_have_no_spread(spark):
    n, step = 600, np.repeat(np.random.default_rng(2).permutation(40), 60)[:600]  # price and volume move once in 60 bars, together
    rows = [("a", datetime.date(2024, 1, 1), i, float(20 + 7.3 * step[i]), float(1 + step[i] * 3)) for i in range(n)]
    got = intraday.day_shapes(spark.createDataFrame(rows, "code string, date date, i int, close double, volume double"), ("i",)).first()
    assert got["lag_spread"] < 1e-12 and got["level_size"] < 1e-12
