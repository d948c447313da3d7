"""Strategy parts and the daily factors against pandas written independently, or figures by hand."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.functions.expr import Compiler
from lattiq.operators import research, strategies
from lattiq.plans import factors

DAY0 = datetime.date(2020, 1, 1)


def day(i):
    return DAY0 + datetime.timedelta(days=i)


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in rows], schema)


def test_daily_factors(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(4):
        close = 20 * np.exp(np.cumsum(rng.standard_normal(330) * 0.02))
        for i, c in enumerate(close):
            o, v = c * (1 + rng.normal() * 0.01), float(rng.integers(100, 900))
            rows.append((day(i), f"c{k}", o, max(o, c) * 1.01, min(o, c) * 0.99, c, v, v * c, c))
    p = pd.DataFrame(rows, columns=["date", "code", "open", "high", "low", "close", "volume", "amount", "vwap"])
    got = Compiler(factors.daily_set()).apply(spark.createDataFrame(p)).toPandas().sort_values(["code", "date"])
    wide = {c: p.pivot(index="date", columns="code", values=c) for c in ("open", "high", "low", "close", "volume", "amount")}
    c, o, v, a = wide["close"], wide["open"], wide["volume"], wide["amount"]
    ret = c.pct_change()
    market = ret.mean(axis=1)
    beta = ret.apply(lambda s: s.rolling(250).cov(market) / market.rolling(250).var())
    s20 = c.rolling(20).std()
    rs = ret.clip(lower=0).rolling(14).mean() / ((-ret).clip(lower=0).rolling(14).mean() + 1e-12)
    want = {
        "mom_20": c / c.shift(20) - 1, "rev_60": -(c / c.shift(60) - 1), "mom_12_1": c.shift(21) / c.shift(252) - 1, "rev_intraday": -(c - o) / o, "rev_rank": (-(c / c.shift(20) - 1)).rank(axis=1, pct=True), "vol_60": ret.rolling(60).std(),
        "ret_skew_60": ret.rolling(60).skew(), "ivol_60": (ret - beta.mul(market, axis=0)).rolling(60).std(), "amihud_20": (ret.abs() / a).rolling(20).mean(), "dolvol_trend": a / a.rolling(20).mean() - 1, "ma_dev_60": c / c.rolling(60).mean() - 1,
        "boll_w": 4 * s20 / c.rolling(20).mean(), "high_52w": c / c.rolling(252).max() - 1, "overnight_gap": o / c.shift(1) - 1, "intraday_range": (wide["high"] - wide["low"]) / c, "drawup_60": c.rolling(60).max() / c - 1, "vol_ratio": v / v.rolling(20).mean(),
        "vol_price_corr": ret.apply(lambda s: s.rolling(20).corr(v[s.name].pct_change())), "amount_strength": a / a.rolling(60).mean() - 1, "rsi_14": 1 - 1 / (1 + rs),
    }
    for name, w in want.items():
        mine = got.pivot(index="date", columns="code", values=name).astype(float)
        seen = w.reindex_like(mine)
        if name == "rsi_14":
            mine, seen = mine[mine.index > day(20)], seen[seen.index > day(20)]
        assert (mine.isna() == seen.isna()).all().all(), name
        assert np.allclose(mine.fillna(0), seen.fillna(0), atol=1e-9), name


def make_long(seed=1, codes=8, days=200):
    rng = np.random.default_rng(seed)
    return [(f, day(d), f"c{k}", float(rng.normal())) for f in ("a", "b") for d in range(days) for k in range(codes)]


def test_fold_weights_and_signal(spark):
    long = pd.DataFrame(make_long(), columns=["factor", "date", "code", "value"])
    rng = np.random.default_rng(9)
    ics = pd.DataFrame([(f, day(d), float(rng.normal(0.02 if f == "a" else -0.02, 0.1))) for f in ("a", "b") for d in range(200) if rng.random() < 0.9], columns=["factor", "date", "ic"])
    df = spark.createDataFrame(long)
    weights = strategies.fold_weights(spark.createDataFrame(ics), df.select("factor", "date")).persist()
    got = {(r["factor"], r["fold"]): (r["turn"], r["weight"]) for r in weights.collect()}
    assert set(got) == {(f, k) for f in "ab" for k in range(6, 10)}
    for (f, k), (turn, weight) in got.items():
        s = ics[ics["factor"] == f].set_index("date")["ic"]
        past, train = s[s.index < day(20 * k)], s[(s.index < day(20 * k)) & (s.index >= day(20 * k - 120))]
        assert turn == (1.0 if past.mean() >= 0 else -1.0) and weight == pytest.approx(abs(train.mean() / train.std()) * 252**0.5)
    signal = strategies.fold_signal(df, weights).toPandas().set_index(["date", "code"])["signal"]
    z = {f: (lambda w: w.sub(w.mean(axis=1), axis=0).div(w.std(axis=1, ddof=0) + 1e-9, axis=0))(long[long["factor"] == f].pivot(index="date", columns="code", values="value")) for f in "ab"}
    for i in (120, 155, 199):
        k = i // 20
        want = sum(z[f].loc[day(i)] * got[f, k][0] * got[f, k][1] for f in "ab") / sum(got[f, k][1] for f in "ab")
        assert np.allclose([signal[day(i), c] for c in want.index], want)
    weights.unpersist()
    with pytest.raises(ValueError):
        strategies.fold_weights(spark.createDataFrame(ics), df, 50, 20)


def test_keep_chain(spark):
    rng = np.random.default_rng(4)
    rows = [(day(d), f"c{k:02d}", *(None if rng.random() < 0.15 else float(np.round(rng.normal(), 1)) for _ in range(2)), None if k == 3 else float(rng.normal())) for d in range(30) for k in range(2 + d % 9)]
    got = {r["date"]: (r["ret"], r["n_held"]) for r in strategies.keep_chain(frame(spark, rows, "date date, code string, s1 double, s2 double, label double"), ["s1", "s2"]).collect()}
    want = {}
    for d in range(30):
        pool = [r for r in rows if r[0] == day(d)]
        for s in (2, 3):
            some = sorted((r for r in pool if r[s] is not None), key=lambda r: (-r[s], r[1]))
            if len(some) < 3:
                break
            pool = some[: max(2, int(len(some) * 0.5))]
        if len(pool) >= 2:
            want[day(d)] = (np.mean([r[4] or 0.0 for r in pool]), len(pool))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hedges_and_strength(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=100) * 0.01
    g = 0.7 * x + rng.normal(size=100) * 0.005
    port = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(g)], "date date, ret double")
    index = spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(x) if i != 5], "date date, ret double")
    x[5] = 0.0
    ols = strategies.hedged(port, index).orderBy("date").toPandas()
    assert np.allclose(ols["beta"], np.cov(g, x)[0, 1] / (np.var(x) + 1e-12)) and np.allclose(ols["net"], g - ols["beta"] * x)
    roll = strategies.hedged(port, index, "rolling").orderBy("date")["date", "beta"].toPandas()["beta"]
    gs, xs = pd.Series(g), pd.Series(x)
    assert np.allclose(roll, (gs.rolling(60).cov(xs) / xs.rolling(60).var()).bfill().fillna(0))
    assert np.allclose(strategies.hedged(port, index, "subtract").orderBy("date").toPandas()["net"], g - x)
    assert {r["beta"] for r in strategies.hedged(port.limit(20), index).collect()} == {0.0}
    with pytest.raises(ValueError):
        strategies.hedged(port, index, "none")

    wide = pd.DataFrame(rng.normal(size=(90, 20)), index=[day(i) for i in range(90)], columns=[f"c{k:02d}" for k in range(20)])
    got = strategies.signal_strength(spark.createDataFrame(wide.rename_axis("date").reset_index().melt("date", var_name="code", value_name="s")), "s").orderBy("date").toPandas()
    spread = wide.apply(lambda r: r.nlargest(2).mean() - r.nsmallest(2).mean(), axis=1).reset_index(drop=True)
    scale = ((spread - spread.rolling(252, min_periods=60).mean()) / (spread.rolling(252, min_periods=60).std() + 1e-9)).clip(0, 1)
    assert np.allclose(got["spread"], spread) and (got["scale"].isna() == scale.isna()).all() and np.allclose(got["scale"].fillna(0), scale.fillna(0))


def test_half_life_crosses_and_years(spark):
    ics = [("a", day(i), v) for i, v in enumerate([0.1, 0.4, 0.4, 0.3, 0.2, 0.1])] + [("b", day(i), v) for i, v in enumerate([-0.1, -0.2])] + [("c", day(0), 0.3), ("c", day(9), 0.2)]
    got = {r["factor"]: r["days"] for r in strategies.half_life(spark.createDataFrame(ics, "factor string, date date, ic double")).collect()}
    assert got == {"a": 3, "b": None, "c": None}
    rows = [("x", day(i), f, s) for i, (f, s) in enumerate([(1.0, 2.0), (3.0, 2.0), (3.0, 2.0), (1.0, 2.0), (2.0, 2.0), (2.0, 2.0)])]
    cross = strategies.with_bars_since_cross(spark.createDataFrame(rows, "code string, date date, f double, s double"), "f", "s").orderBy("date")
    assert [r["bars_since_cross"] for r in cross.collect()] == [0, 1, 1, 2, 3, 1]
    r = frame(spark, [(datetime.date(2021, 1, 1), 0.1, None), (datetime.date(2021, 1, 2), -0.2, 0.1), (datetime.date(2022, 1, 1), 0.0, 0.5)], "date date, a double, b double")
    years = {x["year"]: x for x in strategies.allocation_by_year(r, {"a": 0.5, "b": 0.5}).collect()}
    assert years[2021]["ret"] == pytest.approx(1.05 * 0.95 - 1) and years[2021]["max_fall"] == pytest.approx(-0.05) and years[2022]["ret"] == pytest.approx(0.25) and years[2022]["max_fall"] == 0.0


def test_trees(spark):
    rng = np.random.default_rng(3)
    rows = [(day(10 * i), f"c{k}", float(x), float(y), float(2 * x + rng.normal() * 0.1)) for i in range(190) for k in range(3) for x, y in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "date date, code string, x double, y double, label double")
    folds = research.year_folds(df)
    out = strategies.walk_forward_trees(df, ["x", "y"], "label", folds, trees=5)
    first = folds.agg(F.min("test_from")).first()[0]
    assert out.where(F.col("date") < first).count() == 0 and out.groupBy("date", "code").count().where("count > 1").count() == 0
    assert out.stat.corr("prediction", "label") > 0.8
    assert strategies.walk_forward_trees(df.limit(0), ["x", "y"], "label", folds) is None
