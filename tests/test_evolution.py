"""Evolution of formulas: fronts against brute force, repeatable runs, one query a generation, and what a formula scores."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from lattiq.functions import expr as X
from lattiq.operators import evolution

LABEL = X.lead(X.col("close"), 1) / X.col("close") - 1


def panel(spark, days=50, codes=8):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(codes):
        v = rng.uniform(1, 2, days)
        close = 10 * np.cumprod(1 + 0.05 * np.concatenate([[0], v[:-1] - 1.5]))  # tomorrow's return is today's volume
        rows += [(datetime.date(2024, 1, 1) + datetime.timedelta(days=d), f"c{c}", float(close[d]), float(v[d]), float(rng.uniform())) for d in range(days)]
    return spark.createDataFrame(rows, "date date, code string, close double, volume double, noise double")


def test_front_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, k, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for g in range(4) for k in range(25)]
    got = {(r.g, r.k) for r in evolution.fronts(spark.createDataFrame(rows, "g int, k int, icir double, turnover double"), ["g"]).where("front").collect()}
    beats = lambda a, b: a[2] >= b[2] and a[3] <= b[3] and (a[2] > b[2] or a[3] < b[3])
    assert got == {b[:2] for b in rows if not any(a[0] == b[0] and beats(a, b) for a in rows)}


def test_trees_keep_their_depth():
    rng = random.Random(4)
    columns = ["a", "b"]
    trees = [evolution.random_expr(columns, 3, rng) for _ in range(60)]
    for a, b in zip(trees, trees[1:], strict=False):
        m, c = evolution.mutate(a, columns, 3, rng), evolution.cross(a, b, 3, rng)
        assert evolution.levels(m) <= 4 and evolution.levels(c) <= 4
        assert {x.param[0] for _, x in evolution.places(m) if x.op == "col"} <= set(columns)
    e = X.ts_mean(X.col("a") + X.col("b"), 5)
    assert evolution.put(e, (0, 1), X.col("c")) == X.ts_mean(X.col("a") + X.col("c"), 5) and evolution.text(e) == "ts_mean((a + b), 5)"
    assert len({evolution.text(t) for t in trees}) > 40


def test_scores_equal_pandas(spark):
    p = panel(spark)
    got = {r.factor: r for r in evolution.fitness(p, {"good": X.col("volume"), "smooth": X.ts_mean(X.col("noise"), 5), "flat": X.sign(X.col("close")), "late": X.delay(X.col("volume"), 20)}, LABEL).collect()}
    df = p.toPandas().sort_values(["code", "date"])
    df["y"] = df.groupby("code")["close"].shift(-1) / df["close"] - 1
    df["smooth"] = df.groupby("code")["noise"].rolling(5).mean().reset_index(level=0, drop=True)
    for name, col in (("good", "volume"), ("smooth", "smooth")):
        d = df.dropna(subset=[col, "y"])
        ic = d.groupby("date").apply(lambda g: g[col].rank().corr(g["y"].rank()), include_groups=False)  # noqa: B023
        r = df.dropna(subset=[col]).copy()
        r["r"] = r.groupby("date")[col].rank(pct=True)
        turnover = r.groupby("code")["r"].diff().abs().mean()
        if abs(ic.mean()) >= 0.004 and ic.std() > 0:
            assert got[name].ic == pytest.approx(ic.mean()) and got[name].icir == pytest.approx(ic.mean() / ic.std()) and got[name].turnover == pytest.approx(turnover)
        else:
            assert (got[name].icir, got[name].turnover) == evolution.WORST
        assert got[name].coverage == pytest.approx(df[col].notna().mean())
    assert (got["flat"].icir, got["flat"].turnover) == evolution.WORST == (got["late"].icir, got["late"].turnover) and got["late"].coverage == pytest.approx(0.6)


def test_evolution_is_repeatable_and_one_query_a_generation(spark, monkeypatch):
    asked = []
    plain = evolution.fitness
    monkeypatch.setattr(evolution, "fitness", lambda panel, population, *rest: asked.append(len(population)) or plain(panel, population, *rest))
    p = panel(spark, 40, 6)
    run = lambda: evolution.evolve(p, ["close", "volume", "noise"], LABEL, 8, 3, 5, 2).toPandas().sort_values(["generation", "formula"]).reset_index(drop=True)
    a = run()
    assert len(asked) <= 3 and asked[0] == 8 and sum(asked) <= 24
    b = run()
    pd.testing.assert_frame_equal(a, b)
    assert (a.groupby("generation").size() == 8).all()
    best = a[a["icir"] > -1].groupby("generation")["icir"].max()
    assert best.is_monotonic_increasing  # the front stays
