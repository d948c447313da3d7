"""Purged folds and the ridge search, permutation importance, clusters and mergeable aggregates against numpy and plain loops."""

import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from zeros import sorted_rows, sql_rows

from lattiq.operators import clusters, learning, sketches
from lattiq.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def day(k):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=int(k))


@pytest.mark.parametrize("name", [n for n in ORACLES if n.startswith(("learning_", "sketch_"))])
def test_queries_equal_sql(spark, name):
    got, want = sorted_rows(QUERIES[name](spark, SF).toPandas()), sorted_rows(sql_rows(ORACLES[name], SF))
    assert got == want, [p for p in zip(got, want, strict=False) if p[0] != p[1]][:2]


def test_queries_without_sql_run(spark):
    assert QUERIES["learning_ridge_search"](spark, SF).count() == 12


# -------------------------------------------------------------------------------------------------------- folds and search


def panel(days=60, codes=12, k=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((days * codes, k)) * [1, 10, 0.1, 1] + [0, 5, 0, 0]
    y = 0.3 * x[:, 0] - 0.02 * x[:, 1] + 0.5 * rng.standard_normal(len(x))
    df = pd.DataFrame(x, columns=[f"f{j}" for j in range(k)])
    df.insert(0, "code", [f"c{c}" for _ in range(days) for c in range(codes)])
    df.insert(0, "date", [day(d) for d in range(days) for _ in range(codes)])
    df["label"] = y
    return df


def ridge(x, y, penalty):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-12, sd, 1)
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return y.mean() - w @ mean, w


def test_search_equals_fits_one_by_one(spark):
    df = panel()
    names = ["f0", "f1", "f2", "f3"]
    sets = {"all": names, "some": ["f1", "f0"]}
    got = {(r.subset, r.penalty): r for r in learning.search(spark.createDataFrame(df), names, "label", [0.5, 50.0], 5, 3, 2, sets).collect()}
    for (subset, of), penalty in itertools.product(sets.items(), [0.5, 50.0]):
        ics = []
        for f in range(5):
            low, high = f * 60 // 5, (f + 1) * 60 // 5 - 1
            t = (df["date"] - day(0)).map(lambda d: d.days)
            train = df[(t < low - 3) | (t > high + 3 + 2)]
            a, w = ridge(train[of].to_numpy(), train["label"].to_numpy(), penalty)
            for _, g in df[(t >= low) & (t <= high)].groupby("date"):
                ics.append(pd.Series(a + g[of].to_numpy() @ w).rank().corr(g["label"].reset_index(drop=True).rank()))
        r = got[subset, penalty]
        assert r.n_days == 60 and r.ic == pytest.approx(np.mean(ics), rel=1e-6) and r.icir == pytest.approx(np.mean(ics) / np.std(ics, ddof=1), rel=1e-6)
    assert sorted(r.place for r in got.values()) == [1, 2, 3, 4] and max(got.values(), key=lambda r: r.ic).place == 1


def test_a_leak_over_the_border_is_caught(spark):
    """Labels and features that stay the same for ten dates, and say nothing about each other: only dates next to the test could teach anything, by heart."""
    rng = np.random.default_rng(5)
    rows = []
    for block in range(10):
        x, y = rng.standard_normal((40, 25)), rng.standard_normal(40)
        rows += [(day(10 * block + d), f"c{c}", *map(float, x[c]), float(y[c])) for d in range(10) for c in range(40)]
    names = [f"f{k}" for k in range(25)]
    df = spark.createDataFrame(rows, "date date, code string, " + ", ".join(f"{n} double" for n in names) + ", label double")
    ic = lambda horizon: learning.search(df, names, "label", [1.0], 20, horizon).first().ic
    leaky, purged = ic(0), ic(10)
    assert leaky > 0.1 and purged < leaky / 3


def test_folds_leave_no_label_across_the_border(spark):
    days = spark.createDataFrame([(day(d),) for d in range(97)], "date date")
    rows = learning.purged_folds(days, 4, 6, 3).toPandas()
    rows["i"] = rows["date"].map(lambda d: (d - day(0)).days)
    for _, g in rows.groupby("fold"):
        test, train = set(g[g["role"] == "test"]["i"]), set(g[g["role"] == "train"]["i"])
        assert all(not (set(range(t, t + 7)) & test) for t in train) and all(not (set(range(t, t + 7)) & train) for t in test)
        assert not any(max(test) + 6 < t <= max(test) + 9 for t in train)
    assert sorted(rows[rows["role"] == "test"]["i"]) == list(range(97))


# ------------------------------------------------------------------------------------------------------------- importance


def test_importance_finds_the_planted_feature(spark):
    df = panel(40, 20, 4, 7)
    df["label"] = 3 * df["f2"] * 10 + 0.2 * df["f0"]
    found = {r.feature: r.importance for r in learning.permutation_importance(spark.createDataFrame(df), ["f0", "f1", "f2", "f3"], "label", learning.linear([0.2, 0.0, 30.0, 0.0]), 1).collect()}
    assert max(found, key=found.get) == "f2" and found["f2"] > 0.8 and 0 < found["f0"] < 0.3 and abs(found["f1"]) < 1e-12 and abs(found["f3"]) < 1e-12


def test_every_value_is_dealt_once(spark):
    df = panel(6, 9)
    names = ["f0", "f1", "f2", "f3"]
    rows = learning.permuted(spark.createDataFrame(df), names, 3).toPandas()
    assert len(rows) == 5 * len(df)
    plain = rows[rows["feature"].isna()].set_index(["date", "code"])["x"]
    for f, g in rows[rows["feature"].notna()].groupby("feature"):
        k = names.index(f)
        for d, day_rows in g.groupby("date"):
            own = {c: plain.loc[(d, c)] for c in day_rows["code"]}
            assert sorted(x[k] for x in day_rows["x"]) == sorted(x[k] for x in own.values())
            for c, x in zip(day_rows["code"], day_rows["x"], strict=True):
                assert [v for j, v in enumerate(x) if j != k] == [v for j, v in enumerate(own[c]) if j != k] and x[k] != own[c][k]


def test_importance_by_state_with_a_fitted_model(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df = panel(40, 15, 4, 9)[["date", "code", "f0", "f1", "f2"]]
    df["state"] = [("bull" if d.day % 2 else "bear") for d in df["date"]]
    df["label"] = np.where(df["state"] == "bull", df["f0"], df["f2"] * 10)
    s = spark.createDataFrame(df)
    model = LinearRegression(featuresCol="v").fit(s.select(array_to_vector(F.array("f0", "f1", "f2")).alias("v"), "label"))
    found = learning.permutation_importance(s, ["f0", "f1", "f2"], "label", lambda rows: model.transform(rows.withColumn("v", array_to_vector("x"))), by="state").collect()
    got = {(r.state, r.feature): r.importance for r in found}
    assert got["bull", "f0"] > 0.3 > got["bull", "f2"] and got["bear", "f2"] > 0.3 > got["bear", "f0"]


# --------------------------------------------------------------------------------------------------------------- clusters


def linkage_by_hand(d, limit):
    """One merge at a time, the nearest first."""
    parts = [{i} for i in range(len(d))]
    heights = []
    while len(parts) > 1:
        mean = {(a, b): np.mean([d[i][j] for i in parts[a] for j in parts[b]]) for a, b in itertools.combinations(range(len(parts)), 2)}
        a, b = min(mean, key=lambda p: (mean[p], min(parts[p[0]]), min(parts[p[1]])))
        if mean[a, b] > limit:
            break
        heights.append(mean[a, b])
        parts[a] |= parts[b]
        del parts[b]
    return {frozenset(p) for p in parts}, sorted(heights)


@pytest.mark.parametrize(("seed", "limit"), [(1, 0.9), (3, 99.0)])
def test_clusters_equal_one_merge_at_a_time(spark, seed, limit):
    x = np.random.default_rng(seed).standard_normal((30, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = [(i, j, float(d[i, j])) if (i + j) % 2 else (j, i, float(d[i, j])) for i, j in itertools.combinations(range(30), 2)]
    member, merges = clusters.average_linkage(spark.createDataFrame(pairs, "a long, b long, distance double"), spark.createDataFrame([(i,) for i in range(30)], "item long"), limit)
    groups: dict = {}
    for r in member.collect():
        groups.setdefault(r.cluster, set()).add(r.item)
    want, heights = linkage_by_hand(d, limit)
    assert {frozenset(g) for g in groups.values()} == want and all(k == min(g) for k, g in groups.items())
    rows = merges.collect()
    np.testing.assert_allclose(sorted(r.height for r in rows), heights)
    assert limit < 50 or max(r["round"] for r in rows) < 20  # far fewer rounds than the 29 merges


def test_clusters_of_missing_pairs_and_lone_items(spark):
    pairs = [("a", "b", 0.1), ("b", "c", 0.2), ("d", "e", None), ("x", "x", 0.0)]
    member, _ = clusters.average_linkage(spark.createDataFrame(pairs, "a string, b string, distance double"), spark.createDataFrame([(i,) for i in "abcdex"], "item string"), 1.0)
    assert {r.item: r.cluster for r in member.collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "x": "x"}  # a and c have no distance


# -------------------------------------------------------------------------------------------------------------- sketches


def test_aggregates_do_not_depend_on_partitions(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.integers(5)}", float(np.exp(rng.standard_normal() * 2)) if rng.random() < 0.95 else None) for _ in range(4000)] + [("none", None), ("zero", 0.0), ("one", 5.0)]
    df = spark.createDataFrame(rows, "key string, x double")
    quantiles = {n: {r.key: tuple(r)[1:] for r in sketches.aggregated(df.repartition(n), ["key"], "x", sketches.Quantiles([0.1, 0.5, 0.99])).collect()} for n in (1, 9, 70)}
    assert quantiles[1] == quantiles[9] == quantiles[70] and set(quantiles[1]) == {"hot", "k0", "k1", "k2", "k3", "k4", "zero", "one"}
    values = sorted(x for k, x in rows if k == "hot" and x is not None)
    for q, v in zip((0.1, 0.5, 0.99), quantiles[1]["hot"], strict=True):
        assert v == pytest.approx(values[int(q * (len(values) - 1))], rel=0.0101)
    assert quantiles[1]["zero"] == (0.0, 0.0, 0.0)
    for n in (1, 40):
        m = {r.key: r for r in sketches.aggregated(df.repartition(n), ["key"], "x", sketches.Moments()).collect()}
        s = pd.Series(values)
        d = s - s.mean()
        assert m["hot"].n == len(s) and m["hot"]["mean"] == pytest.approx(s.mean()) and m["hot"].sd == pytest.approx(s.std()) and m["hot"].skew == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and m["hot"].kurtosis == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)
        assert m["one"].sd is None and m["one"].skew is None
    assert sketches.aggregated(df.where("x < 0"), ["key"], "x", sketches.Moments()).count() == 0
