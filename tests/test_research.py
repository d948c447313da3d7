"""Factor sets chosen and followed, themes and shadow accounts against plain loops or figures by hand."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattiq.operators import frozen, shadow

DAY0 = datetime.date(2023, 1, 1)


def make_wide(codes=14, days=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for k in range(codes):
            label = rng.standard_normal() * 0.02
            rows.append((DAY0 + datetime.timedelta(days=d), f"c{k:02d}", label * 3 + rng.standard_normal() * 0.05, -label + rng.standard_normal() * 0.1, None if rng.random() < 0.1 else round(rng.standard_normal(), 1), None if rng.random() < 0.05 else label))
    return pd.DataFrame(rows, columns=["date", "code", "good", "bad", "holes", "label"])


def wide_frame(spark, p):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and v != v else v for v in r) for r in p.itertuples(index=False)], "date date, code string, good double, bad double, holes double, label double")


def loop_ics(p, name):
    out = {}
    for day, g in p.sort_values(["date", "code"]).groupby("date"):
        place = [np.argsort(np.argsort(np.where(g[c].isna(), np.inf, g[c].astype(float)), kind="stable"), kind="stable").astype(float) for c in (name, "label")]
        both = (g[name].notna() & g["label"].notna()).to_numpy()
        if both.sum() >= 10:
            out[day] = np.corrcoef(place[0][both], place[1][both])[0, 1]
    return pd.Series(out)


def test_frozen_sets(spark):
    p = make_wide()
    df, names = wide_frame(spark, p), ["good", "bad", "holes"]
    long = frozen.long_rows(df, names)
    ics = frozen.ordinal_ics(long).persist()
    split = DAY0 + datetime.timedelta(days=60)
    scores = {r["factor"]: r for r in frozen.split_scores(ics, str(split)).collect()}
    fallen = {r["factor"]: r for r in frozen.decay(ics).collect()}
    for name in names:
        want = loop_ics(p, name)
        got = ics.where(F.col("factor") == name).toPandas().set_index("date")["ic"].sort_index()
        assert list(got.index) == list(want.index) and np.allclose(got, want)
        before, after = want[want.index <= split], want[want.index >= split]
        s = scores[name]
        assert np.isclose(s["before_ic"], before.mean()) and np.isclose(s["after_ir"], after.mean() / after.std())
        assert s["alive"] == (before.mean() > 0)
        assert np.isclose(fallen[name]["recent_ic"], want[-60:].mean()) and np.isclose(fallen[name]["base_ic"], want.mean())
        assert fallen[name]["decayed"] == (want[-60:].mean() < 0 or 0 < want.mean() and want[-60:].mean() < 0.3 * want.mean())
    assert scores["good"]["alive"] and not scores["bad"]["alive"] and fallen["bad"]["decayed"]
    assert frozen.renewal(frozen.decay(ics)).first()["renew"] == (sum(r["decayed"] for r in fallen.values()) / 3 > 0.4)

    table = spark.createDataFrame([(n, scores[n]["before_ic"], scores[n]["before_ir"], scores[n]["alive"]) for n in names], "factor string, before_ic double, before_ir double, alive boolean")
    signal = frozen.blend(long, table).toPandas().set_index(["date", "code"])["signal"]
    alive = [n for n in names if scores[n]["alive"]]
    want = sum(abs(scores[n]["before_ir"]) * p.set_index(["date", "code"])[n].astype(float).fillna(0) for n in alive) / sum(abs(scores[n]["before_ir"]) for n in alive)
    assert np.allclose(signal.sort_index(), want.sort_index())
    assert frozen.blend(long, table.where("factor = 'bad'")).count() == 0
    cover = {r["factor"]: r["coverage"] for r in frozen.coverage(df, names).collect()}
    assert np.isclose(cover["holes"], p["holes"].notna().mean()) and cover["good"] == 1.0
    ics.unpersist()


def test_top_share_and_chance(spark):
    p = make_wide(codes=13, days=33)
    df = wide_frame(spark, p)
    port, market = frozen.top_share(df, F.col("good")), frozen.top_share(df, F.lit(1.0), share=1.0, cost=0.0)
    got = port.toPandas().set_index("date")["ret"].sort_index()
    want = {}
    for i, (day, g) in enumerate(p.groupby("date")):
        g = g.dropna(subset=["good", "label"])
        if i % 5 == 0 and len(g) >= 5:
            want[day] = g.sort_values(["good", "code"], ascending=[False, True]).head(max(3, int(len(g) * 0.3)))["label"].mean() - 0.3 * 2 * 0.001
    assert list(got.index) == list(want) and np.allclose(got, list(want.values()))
    chance = frozen.top_share(df, frozen.by_chance(7))
    assert [r["ret"] for r in chance.orderBy("date").collect()] == [r["ret"] for r in frozen.top_share(df.repartition(5), frozen.by_chance(7)).orderBy("date").collect()]
    s = frozen.against(port, market, chance).first()
    assert np.isclose(s["sharpe"], got.mean() / got.std() * (252 / 5) ** 0.5)
    assert np.isclose(s["total"], np.prod(1 + got) - 1) and np.isclose(s["annual"], (1 + got.mean()) ** 50.4 - 1)
    curve = np.cumprod(1 + got)
    assert np.isclose(s["max_fall"], (curve / np.maximum.accumulate(curve) - 1).min())
    assert frozen.top_share(df.limit(0), F.col("good")).count() == 0


def test_horizons(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame([(DAY0 + datetime.timedelta(days=d), f"c{k:02d}", float(rng.normal()), float(20 + rng.random())) for k in range(22) for d in range(40)], columns=["date", "code", "f", "close"])
    got = {r["horizon"]: r for r in frozen.horizon_scores(spark.createDataFrame(p), "f", (5, 35)).collect()}
    wide, close = p.pivot(index="date", columns="code", values="f"), p.pivot(index="date", columns="code", values="close")
    ahead = close.shift(-5) / close - 1
    ic = wide.rank(axis=1).corrwith(ahead.rank(axis=1), axis=1).dropna()
    assert np.isclose(got[5]["ic"], ic.mean()) and np.isclose(got[5]["icir"], ic.mean() / ic.std(ddof=0)) and got[5]["n"] == len(ic)
    assert (got[35]["ic"], got[35]["icir"], got[35]["n"]) == (0.0, 0.0, 0)  # five days are too few


def test_themes(spark):
    themes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "factor string, themes array<string>")
    rows = spark.createDataFrame([("a", "alive", 0.2), ("b", "alive", -0.5), ("c", "dead", 0.0), ("d", "reversed", -1.0)], "factor string, category string, ir double")
    got = {r["theme"]: (r["alive"], r["reversed"], r["dead"], r["count"]) for r in frozen.theme_counts(rows, themes).collect()}
    assert got == {"x": (2, 0, 0, 2), "y": (1, 0, 0, 1), "uncategorised": (0, 1, 1, 2)}
    assert {(r["theme"], r["place"], r["factor"]) for r in frozen.alive_by_theme(rows, themes).collect()} == {("x", 1, "b"), ("x", 2, "a"), ("y", 1, "a")}
    pairs = spark.createDataFrame([("a", "b", -0.6), ("a", "c", 0.2), ("b", "c", None)], "a string, b string, corr double")
    found = {(r["theme_a"], r["theme_b"]): r["corr"] for r in frozen.theme_correlations(pairs, themes).collect()}
    assert found[("x", "x")] == pytest.approx(0.6) and found[("x", "y")] == pytest.approx(0.6) and found[("uncategorised", "y")] == pytest.approx(0.2)


def make_trips(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        long = i % 2
        buy = datetime.datetime(2023, 1, 2, 10 if long else 14) + datetime.timedelta(days=int(rng.integers(0, 60)))
        rows.append((f"s{i % 4}", i, 1000 + i, buy, buy + datetime.timedelta(days=(20 if long else 2) + float(rng.random()) * 0.5), 1.0, 10.0, 11.0, float(np.round(rng.normal(1, 3), 1))))
    return spark.createDataFrame(rows, "symbol string, buy_id long, sell_id long, buy_at timestamp, sell_at timestamp, matched double, buy_price double, sell_price double, pnl double")


def test_shadow_rules(spark):
    trips = make_trips(spark).withColumn("pnl", F.lit(1.0))
    markets = spark.createDataFrame([("s0", "us"), ("s1", "us"), ("s1", "us"), ("s2", "us")], "symbol string, market string")
    prices = spark.createDataFrame([(f"s{k}", DAY0 + datetime.timedelta(days=d), 50.0 + d, d / 100) for k in range(4) for d in range(0, 60, 10)], "symbol string, date date, entry_rsi14 double, prior_5d_return double")
    features = shadow.trip_features(trips, markets, prices)
    for r in features.collect():
        last = (r["buy_at"].date() - DAY0).days // 10 * 10
        assert r["entry_rsi14"] == 50.0 + min(last, 50) and r["entry_weekday"] == r["buy_at"].weekday() and r["market"] == ("other" if r["symbol"] == "s3" else "us")
    by_hand = features.withColumn("cluster", F.when(F.col("holding_days") > 10, 0).otherwise(1))
    found = {r["days_low"]: r for r in shadow.rules(by_hand).collect()}
    assert set(found) == {2, 20} and found[20]["hour_low"] == found[20]["hour_high"] == 10 and found[2]["support"] == 20 and found[2]["coverage"] == 0.5
    p = features.where("holding_days > 10").toPandas()
    assert found[20]["days_high"] == round(p["holding_days"].quantile(0.9)) and found[20]["entry_rsi14_low"] == pytest.approx(round(p["entry_rsi14"].quantile(0.1), 4))
    assert shadow.holding_range(shadow.rules(by_hand)) == (2.0, float(found[20]["days_high"]))
    # k-means finds the two habits by itself
    plain = shadow.clusters(shadow.trip_features(trips, markets))
    assert plain.count() == 40 and plain.groupBy("cluster").agg((F.max("holding_days") - F.min("holding_days")).alias("w")).where("w > 5").count() == 0
    # fewer trips than a rule needs, and none
    few = shadow.clusters(features.limit(2))
    assert [r["support"] for r in shadow.rules(few).collect()] == [2]
    none = shadow.clusters(shadow.trip_features(trips.limit(0), markets))
    assert shadow.rules(none).count() == 0 and shadow.holding_range(shadow.rules(none)) == (1.0, 30.0)


def test_shadow_attribution(spark):
    trips = make_trips(spark, 60, 8)
    p = trips.toPandas()
    hold = (p["sell_at"] - p["buy_at"]).dt.total_seconds() / 86400
    low, high, typical = 2.25, 20.2, 2.0
    outside = (hold < low) | (hold > high)
    want = {
        "noise": -p["pnl"][outside].sum(), "early_exit": (p["pnl"] * (low - hold) / low)[(p["pnl"] > 0) & (hold < low)].sum(), "late_exit": (-p["pnl"] * (hold - high) / high)[(p["pnl"] < 0) & (hold > high)].sum(),
    }
    span = (p["sell_at"].max() - p["buy_at"].min()).total_seconds() / 86400
    extra = int(60 - max(1.0, span / (2 * typical)))
    order = p.assign(size=p["pnl"].abs()).sort_values(["size", "pnl"])["pnl"]
    want["overtrading"] = -order.head(extra).sum()
    got = shadow.attribution(trips, low, high, typical, 50.0).first()
    for name, value in want.items():
        assert got[name] == pytest.approx(value), name
    assert got["missed"] == pytest.approx(50.0 - p["pnl"].sum() - sum(want.values()))
    assert shadow.overtrading_cost(trips, 1e-9 - 1e-9).first()["overtrading"] == 0.0 and shadow.overtrading_cost(trips, 1000.0).first()["overtrading"] == pytest.approx(-order.head(59).sum())
    empty = shadow.attribution(trips.limit(0), low, high, typical, 5.0).first()
    assert empty["real_pnl"] == 0.0 and empty["missed"] == 5.0
    reasons = frozen.exit_reasons(trips.withColumn("exit_reason", F.col("symbol"))).collect()
    assert {r["exit_reason"]: r["n_trades"] for r in reasons} == {f"s{k}": 15 for k in range(4)}


def test_shadow_scan(spark):
    rows = [("up", DAY0 + datetime.timedelta(days=d), 10.0 + d, 100.0 + d) for d in range(30)] + [("down", DAY0 + datetime.timedelta(days=d), 50.0 - d, None) for d in range(30)] + [("new", DAY0, 5.0, 1.0), ("two", DAY0, 5.0, 1.0), ("two", DAY0 + datetime.timedelta(days=1), 6.0, 3.0)]
    f = shadow.last_bar_features(spark.createDataFrame(rows, "code string, date date, close double, volume double"))
    got = {r["code"]: r for r in f.collect()}
    assert set(got) == {"up", "down", "two"}  # one bar is too few
    assert got["up"]["momentum"] == pytest.approx(39 / 34 - 1) and got["up"]["volume_ratio"] == pytest.approx(129 / np.mean([124, 125, 126, 127, 128]))
    assert got["down"]["volume_ratio"] is None and not got["down"]["price_above_ma"] and got["two"]["momentum"] == pytest.approx(0.2) and got["two"]["volume_ratio"] == 3.0
    bars = f.withColumn("market", F.lit("us"))
    found = shadow.scan(bars, {"R1": ("us", {}), "R2": ("us", {"momentum": (None, 0.0)}), "R3": ("hk", {}), "R4": ("us", {"entry_rsi14": (0.0, None)}), "R5": ("us", {"price_above_ma": True, "volume_ratio": (2.0, None)})})
    assert {(r["rule"], r["code"]) for r in found.collect()} == {("R1", "two"), ("R1", "up"), ("R2", "down"), ("R5", "two")}
    assert shadow.scan(bars, {"R1": ("us", {})}, per_market=1).count() == 1
