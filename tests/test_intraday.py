"""Minute-bar and daily-bar factors, candlesticks and the life cycle against plain numpy and pandas statements of their definitions."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.functions.expr import Compiler
from lattiq.operators import candles, evaluation, research, simulation
from lattiq.plans import intraday


def make_minutes(seed=5, days=8, codes=6, bars=60):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(codes):
        for d in range(days):
            n = bars if (c + d) % 7 else 12  # some days are too short
            close = 10 + np.cumsum(rng.standard_normal(n) * 0.02)
            vol = rng.integers(1, 500, n).astype(float)
            for i in range(n):
                rows.append((f"c{c}", datetime.date(2024, 1, 1 + d), i, float(close[i]), float(close[i] + abs(rng.standard_normal()) * 0.01), float(close[i] - abs(rng.standard_normal()) * 0.01), float(close[i]), vol[i], float(close[i] * vol[i])))
    return pd.DataFrame(rows, columns=["code", "date", "minute", "open", "high", "low", "close", "volume", "amount"])


def by_hand(g):
    c, h, low, v, a = (g[k].to_numpy() for k in ("close", "high", "low", "volume", "amount"))
    n, out = len(c), {}
    if n <= 20:
        return out
    r = np.diff(np.log(c))
    pos = (0.5 * (c / np.minimum.accumulate(c) - 1) + 0.5 * (np.maximum.accumulate(c) / c - 1))[1:]
    weighted = lambda key, w: float(np.sum((2 * np.arange(1, n) - n) * w[np.argsort(key, kind="stable")]))
    out |= {"game_ret": weighted(r, v[1:]), "game_pos": weighted(pos, v[1:]), "game_amp": weighted(r, ((h - low) / c)[1:])}
    v5 = pd.Series(r).rolling(5).std(ddof=0)
    amb = v5.rolling(5).std(ddof=0)
    ok = amb.notna().to_numpy()
    fog = amb[ok].to_numpy() > amb[ok].mean()
    out["cloud_corr"] = np.corrcoef(amb[ok], a[1:][ok])[0, 1]
    out["cloud_amount"] = a[1:][ok][fog].mean() / (a[1:][ok].mean() + 1e-10)
    dv = np.diff(v)
    up, down = dv > dv.mean() + dv.std(), dv < dv.mean() - dv.std()
    enough = up.sum() >= 2 and down.sum() >= 2
    out["treat_ret"] = np.log(c[-1] / c[0]) * abs(r[up].mean() - r[down].mean()) if enough else 0.0
    out["treat_vol"] = np.log(c[-1] / c[0]) * abs(np.nanmean(v5[up]) - np.nanmean(v5[down])) if enough else 0.0
    out["jump"] = np.mean(2 * ((c[1:] / c[:-1] - 1) - r) - r**2)
    s = np.abs(r) / np.sqrt(v[1:])
    order = np.argsort(-s, kind="stable")
    cum = np.cumsum(v[1:][order])
    take = order[: np.searchsorted(cum, 0.2 * cum[-1]) + 1]
    out["smart_money"] = (np.sum(c[1:][take] * v[1:][take]) / v[1:][take].sum()) / (np.sum(c[1:] * v[1:]) / v[1:].sum())
    mean5 = pd.Series(v).rolling(5).mean().to_numpy()
    spike = np.where(np.isnan(mean5), False, v > 2 * mean5)
    amp = (h - low) / c
    out["elasticity"] = 1 - (amp[spike].mean() if spike.any() else 0) / amp[~spike].mean()
    return out


def test_daily_factors_by_hand(spark):
    m = make_minutes()
    got = intraday.daily_factors(spark.createDataFrame(m), ("minute",)).toPandas().set_index(["code", "date"])
    some = 0
    for key, g in m.groupby(["code", "date"]):
        want = by_hand(g)
        for name, x in want.items():
            np.testing.assert_allclose(got.loc[key, name], x, rtol=1e-7, atol=1e-10, err_msg=f"{key} {name}")
            some += 1
        if not want:
            assert got.loc[key, "game_ret"] is None or np.isnan(got.loc[key, "game_ret"])
    assert some > 300


def test_bar_factors_by_hand(spark):
    rng = np.random.default_rng(9)
    days = pd.date_range("2024-01-01", periods=90)
    p = pd.DataFrame([(f"c{k}", d.date(), *x) for k in range(3) for d, x in zip(days, np.column_stack([10 + np.cumsum(rng.standard_normal(90) * 0.1), 10 + np.cumsum(rng.standard_normal(90) * 0.1), rng.integers(10, 99, 90)]).tolist(), strict=True)], columns=["code", "date", "open", "close", "volume"])
    got = intraday.bar_factors(spark.createDataFrame(p)).toPandas().sort_values(["code", "date"]).set_index("code")
    ret = p.pivot(index="date", columns="code", values="close").pct_change()
    market = ret.mean(axis=1)
    for code, g in p.groupby("code"):
        c, v = g["close"].reset_index(drop=True), g["volume"].reset_index(drop=True)
        r = c.pct_change()
        own = got.loc[code].reset_index(drop=True)
        pairs = {
            "downside": np.sqrt((r.clip(upper=0) ** 2).rolling(20, min_periods=10).mean()), "amihud": (r.abs() / v).rolling(20).mean(), "divergence": c.rolling(20).corr(v),
            "percentile": c.rolling(60, min_periods=20).apply(lambda w: (w[:-1] < w[-1]).mean() * (len(w) - 1) / len(w), raw=True), "reversal_equal": np.log(c / c.shift()).rolling(20).mean(),
        }
        for name, want in pairs.items():
            np.testing.assert_allclose(own[name].astype(float), want, rtol=1e-6, err_msg=name)
        x, y = market.reset_index(drop=True), r
        for at in (30, 60, 89):
            a, b = x[at - 20 : at], y[at - 20 : at]
            beta = np.cov(b, a, ddof=0)[0, 1] / np.var(a)
            np.testing.assert_allclose(own["idio_vol"][at], np.std(b - beta * a), rtol=1e-6)


def test_candles_by_hand(spark):
    bars = [(10.0, 10.3, 9.0, 10.2), (10.2, 10.25, 9.6, 9.7), (9.6, 10.6, 9.5, 10.5), (10.0, 10.05, 9.95, 10.0)]
    p = spark.createDataFrame([("a", datetime.date(2024, 1, 1 + i), *b) for i, b in enumerate(bars)], "code string, date date, open double, high double, low double, close double")
    got = Compiler(candles.patterns()).apply(p).orderBy("date").toPandas()
    assert got["hammer"].tolist() == [1, 0, 0, 0]
    assert got["engulfing"].tolist() == [0, -1, 1, 0]
    assert got["doji"].tolist() == [0, 0, 0, 1]
    assert got["candle"].iloc[2] == 1


def test_lifecycle_states(spark):
    days = pd.date_range("2024-01-01", periods=120)
    ic = np.where(np.arange(120) < 60, 0.05, np.where(np.arange(120) < 100, -0.05, 0.0)) + np.tile([0.01, -0.01], 60)
    s = evaluation.rolling_lifecycle(spark.createDataFrame(pd.DataFrame({"date": days.date, "ic": ic})), window=30)
    got = s.orderBy("date").toPandas()
    x = pd.Series(ic)
    m, sd, pos = x.rolling(30, min_periods=10).mean(), x.rolling(30, min_periods=10).std(), (x > 1e-12).astype(float).rolling(30, min_periods=10).mean()
    alive = (m.abs() >= 0.015) & ((m / sd).abs() >= 0.2) & (pos >= 0.45)
    lately = (m.abs() >= 0.015).rolling(20, min_periods=1).max() == 1
    want = np.where(m.isna(), "warming", np.where(alive, "alive", np.where(lately, "decaying", "dead")))
    assert got["state"].tolist() == want.tolist() and set(want) >= {"warming", "alive", "decaying"}
    early = s.where(F.col("date") <= days[40].date())
    r = evaluation.lifecycle(early).first()
    assert r.status == "alive" and r.alive_since == days[9].date() and r.alive_days == 31


def test_stacked_ridge_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(datetime.date(2024, 1, 1) + datetime.timedelta(days=d), f"c{k}", *rng.standard_normal(3).tolist()) for d in range(40) for k in range(8)]
    p = pd.DataFrame(rows, columns=["date", "code", "a", "b", "y"])
    got = research.stacked_ridge(spark.createDataFrame(p), "a", "b", "y", window=20, warmup=15).toPandas().set_index(["date", "code"])["stacked"]
    days = sorted(p["date"].unique())
    for i in (5, 15, 30, 39):
        now = p[p["date"] == days[i]]
        past = p[p["date"].isin(days[max(0, i - 20) : i])]
        want = np.zeros(len(now))
        if i >= 15:
            x, y = past[["a", "b"]].to_numpy(), past["y"].to_numpy()
            mu, sd = x.mean(0), x.std(0) + 1e-9
            xs = (x - mu) / sd
            w = np.linalg.solve(xs.T @ xs + np.eye(2), xs.T @ (y - y.mean()))
            want = (now[["a", "b"]].to_numpy() - mu) / sd @ w
        np.testing.assert_allclose([got[k] for k in zip(now["date"], now["code"], strict=True)], want, atol=1e-9)


def test_fees_and_limits_of_a_market(spark):
    rules = simulation.MARKETS["china_a"]
    np.testing.assert_allclose([simulation.trade_fee(rules, 1000.0, False), simulation.trade_fee(rules, 100_000.0, True)], [5.01, 25 + 1 + 50])
    bars = [(0, 1, "a", 10.0, 10.0, 0.0), (0, 2, "a", 11.0, 11.0, 0.5), (0, 3, "a", 11.0, 11.0, 0.5), (0, 4, "a", 9.9, 9.9, 0.0), (0, 5, "a", 9.9, 9.9, 0.0)]
    df = spark.createDataFrame(bars, "run int, date int, code string, open double, close double, weight double")
    got = simulation.simulate(df, "china_a", cash=100_000.0).orderBy("date").toPandas()
    assert got["trades"].tolist() == [0, 0, 1, 0, 1]  # no purchase at the upper limit, no sale at the lower one
    bought = 4500 * 11 * 1.001
    free = 100_000 - bought - max(5, bought * 0.00025) - bought * 0.00001
    np.testing.assert_allclose(got["cash"].iloc[2], free)
    sold = 4500 * 9.9 * 0.999
    np.testing.assert_allclose(got["cash"].iloc[4], free + sold - sold * 0.00025 - sold * 0.00051)


def test_day_shapes_and_followed_peaks(spark):
    rng = np.random.default_rng(21)
    rows = [(f"c{k}", datetime.date(2024, 1, 1 + d), i, float(10 * np.exp(rng.normal() * 0.01)), float(rng.integers(1, 30) if k else 7)) for k in range(3) for d in range(2) for i in range(8 if k == 2 and d else 90)]
    df = spark.createDataFrame(rows, "code string, date date, i int, close double, volume double").repartition(5)
    follow = {(r["code"], r["date"]): r["follow"] for r in intraday.followed_peaks(df.withColumnRenamed("i", "at"), ("at",)).collect()}
    shapes = {(r["code"], r["date"]): r for r in intraday.day_shapes(df, ("i",)).collect()}
    p = pd.DataFrame(rows, columns=["code", "date", "i", "close", "volume"])
    for key, g in p.groupby(["code", "date"]):
        v, c = g["volume"].to_numpy(), g["close"].to_numpy()
        s = shapes[key]
        if len(v) < 30:
            assert follow[key] is None and s["ripple"] is None and s["level"] is None
            continue
        kept = []
        for t in sorted(np.argsort(-v, kind="stable")[:10]):
            if not kept or t - kept[-1] > 5:
                kept.append(t)
        want = np.mean([v[t + 1 : t + 6].sum() / v[t] for t in kept]) if len(kept) >= 2 else None
        assert follow[key] == (None if want is None else pytest.approx(want))
        if key[0] == "c0":  # volume never moves: no power, no regression
            assert s["ripple"] is None and s["level"] is None
            continue
        q1, q3 = np.quantile(v, [0.25, 0.75])
        x = np.clip(v, np.median(v) - 3 * (q3 - q1), np.median(v) + 3 * (q3 - q1))
        n = len(v)
        x = (x - x.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
        power = [abs(sum(x[j] * np.exp(-2j * np.pi * f * j / n) for j in range(n))) ** 2 for f in range(n // 2 + 1)]
        assert s["ripple"] == pytest.approx(sum(power[round(0.4 * (n // 2)) :]) / sum(power[1:]))
        r, dv = np.diff(np.log(c)), np.diff(v)
        spreads, levels = [], []
        for last in range(36, len(r)):
            a = np.array([[1.0, *(dv[t - lag] for lag in range(6))] for t in range(last - 29, last + 1)])
            y = r[last - 29 : last + 1]
            b = np.linalg.solve(a.T @ a, a.T @ y)
            e = y - a @ b
            t = b / np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (e @ e) / 23)
            spreads.append(np.std(t[2:]))
            levels.append(t[0])
        assert s["lag_spread"] == pytest.approx(np.mean(spreads), rel=1e-6) and s["level"] == pytest.approx(np.mean(levels), rel=1e-6) and s["level_size"] == pytest.approx(np.mean(np.abs(levels)), rel=1e-6)
