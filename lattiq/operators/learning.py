"""Choice of a model's parameters over purged folds, and what a model owes to each feature. Training data meet as moments and never as rows: a fold's fit needs sums of products, which tasks add up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .correlations import _average_ranks

#: What a deviation must exceed, and the least codes of a date that is scored.
FLAT, LEAST_CODES = 1e-12, 5


def purged_folds(days: DataFrame, folds: int, horizon: int, embargo: int = 0, date: str = "date") -> DataFrame:
    """date, fold, role of every date and fold: dates are cut into `folds` runs of about equal length; a fold's own run is its test, and the others train, but for dates whose label (of `horizon` dates ahead) reaches into the test
    or that a test label reaches into, and for `embargo` more dates after it. Those have the role "left out"."""
    d = days.select(date).distinct().select(date, (F.row_number().over(W.orderBy(date)) - 1).alias("_i"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))  # a row a date
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    low, high = F.floor(F.col("fold") * F.col("_n") / folds), F.floor((F.col("fold") + 1) * F.col("_n") / folds) - 1
    role = F.when((F.col("_i") >= low) & (F.col("_i") <= high), "test").when((F.col("_i") < low - horizon) | (F.col("_i") > high + horizon + embargo), "train").otherwise("left out")
    return d.select(date, "fold", role.alias("role"))


def _fold_moments(rows: DataFrame, folds: int) -> dict[int, np.ndarray]:
    """rows (v: 1, features, label as one array; train: array of folds that learn from the row) -> a fold's sum of outer products of v. Tasks add up rows by their set of folds; what reaches the driver is a matrix per fold."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column("v").flatten(), float).reshape(batch.num_rows, -1)
            mask = np.asarray(batch.column("mask"))
            for m in np.unique(mask):
                x = v[mask == m]
                total[int(m)] = total.get(int(m), 0) + x.T @ x
        for m, x in total.items():
            for f in range(folds):
                if m >> f & 1:
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array(np.arange(x.size, dtype=np.int32)[None].tolist(), pa.list_(pa.int32())), pa.array([x.ravel().tolist()], pa.list_(pa.float64()))], ["fold", "at", "x"])

    parts = rows.mapInArrow(run, "fold int, at array<int>, x array<double>").select("fold", F.explode(F.arrays_zip("at", "x")).alias("e"))
    sums = parts.groupBy("fold", F.col("e.at").alias("at")).agg(F.sum("e.x").alias("x")).toPandas().sort_values(["fold", "at"])
    return {int(f): (x := g["x"].to_numpy()).reshape(int(round(len(x) ** 0.5)), -1) for f, g in sums.groupby("fold")}


def ridge_from_moments(m: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and weights of a ridge fit on standardised features, in terms of the raw ones, from sums of outer products of (1, features, label)."""
    n, k = m[0, 0], len(m) - 2
    mean = m[0, 1:] / n
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    live = sd > FLAT
    scale = np.where(live, sd, 1)
    a = cov[:k, :k] / np.outer(scale, scale) * n + penalty * np.eye(k)
    a[~live] = a[:, ~live] = 0
    a[~live, ~live] = 1
    w = np.where(live, np.linalg.solve(a, np.where(live, cov[:k, k] / scale * n, 0)) / scale, 0)
    return np.concatenate([[mean[k] - w @ mean[:k]], w])


def search(df: DataFrame, features: list[str], label: str, penalties: list[float], folds: int = 5, horizon: int = 5, embargo: int = 0, sets: dict[str, list[str]] | None = None, date: str = "date") -> DataFrame:
    """subset, penalty, ic (mean daily rank correlation of prediction and label over all tests), icir, n_days, place (1: highest ic): every penalty with every subset of features (all of them by default), over purged folds.

    Rows without a label or with a missing feature are left out. All fits of all parameters come from one pass for moments, all predictions from one more. Folds are at most 62.
    """
    sets = sets or {"all": features}
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, label]))
    roles = purged_folds(rows, folds, horizon, embargo, date)
    one = roles.groupBy(date).agg(F.sum(F.when(F.col("role") == "train", F.expr("shiftleft(bigint(1), fold)")).otherwise(0)).alias("mask"), F.max(F.when(F.col("role") == "test", F.col("fold"))).alias("fold"))
    v = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in [*features, label]))
    rows = rows.select(date, v.alias("v")).join(F.broadcast(one), date)
    moments = _fold_moments(rows.select("v", "mask"), folds)
    params = [(name, p) for name in sets for p in penalties]
    place = {c: k + 1 for k, c in enumerate(features)}
    weights = np.zeros((folds, len(params), len(features) + 1))
    for f, m in moments.items():
        for k, (name, p) in enumerate(params):
            at = [0, *(place[c] for c in sets[name])]
            weights[f, k, at] = ridge_from_moments(m[np.ix_([*at, len(m) - 1], [*at, len(m) - 1])], p)

    def score(table: pa.Table) -> pa.Table:
        x = np.asarray(table.column("v").combine_chunks().flatten(), float).reshape(table.num_rows, -1)
        f = table.column("fold")[0].as_py()
        if len(x) < LEAST_CODES or f not in moments:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.float64())], ["param", "ic"])
        r = _average_ranks(np.column_stack([x[:, :-1] @ weights[f].T, x[:, -1]]))
        r -= r.mean(0)
        size = np.sqrt((r * r).sum(0))
        ok = np.flatnonzero((size[:-1] > FLAT) & (size[-1] > FLAT))
        ic = (r[:, ok].T @ r[:, -1]) / (size[ok] * size[-1]) if len(ok) else np.zeros(0)
        return pa.table([pa.array(ok.astype(np.int32)), pa.array(ic)], ["param", "ic"])

    daily = rows.select(date, "fold", "v").groupBy(date).applyInArrow(score, "param int, ic double")
    found = daily.groupBy("param").agg(F.avg("ic").alias("ic"), F.stddev_samp("ic").alias("_s"), F.count(F.lit(1)).alias("n_days"))
    named = F.array(*(F.struct(F.lit(name).alias("subset"), F.lit(float(p)).alias("penalty")) for name, p in params))[F.col("param")]
    found = found.select(named["subset"].alias("subset"), named["penalty"].alias("penalty"), "ic", F.try_divide("ic", F.nullif("_s", F.lit(0.0))).alias("icir"), "n_days")
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc("ic"), "subset", "penalty")))  # a row a parameter set


def permuted(df: DataFrame, features: list[str], seed: int = 0, date: str = "date", code: str = "code") -> DataFrame:
    """df's date, code and label columns, feature and x (array of the features' values): each row once as it is (feature NULL), and once for each feature with that value taken from another code of the date.

    The codes of a date stand in an order by hash, and each takes the value of the one before it (the first of the last), so one window serves all features, and every value is used once.
    """
    order = F.md5(F.concat_ws("|", F.col(code).cast("string"), F.col(date).cast("string"), F.lit(str(seed))))
    w = W.partitionBy(date).orderBy(order, code)
    x = F.array(*(F.col(c).cast("double") for c in features))
    d = df.withColumn("_x", x)
    last = F.last_value("_x").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    d = d.withColumn("_y", F.coalesce(F.lag("_x").over(w), last)).drop(*features)
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    mixed = F.transform("_x", lambda v, k: F.when(k == F.col("_k"), F.get("_y", k)).otherwise(v))
    name = F.get(F.array(*map(F.lit, features)), F.col("_k"))
    return d.withColumns({"x": mixed, "feature": F.when(F.col("_k") >= 0, name)}).drop("_x", "_y", "_k")


def permutation_importance(df: DataFrame, features: list[str], label: str, predict: Callable[[DataFrame], DataFrame], seed: int = 0, date: str = "date", code: str = "code", by: str | None = None) -> DataFrame:
    """feature, importance, ic, n_days (and the column `by`, such as a market's state by date): what the mean daily rank correlation of prediction and label loses when a feature's values are dealt anew among the codes of each date.

    predict gets rows with x and adds the column prediction; all features are scored in one pass. Rows with a missing feature or label are left out.
    """
    keep = [c for c in (date, code, label, by) if c]
    rows = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, label])).select(*keep, *features)
    p = predict(permuted(rows, features, seed, date, code)).where("prediction IS NOT NULL")
    keys = [date, "feature", *([by] if by else [])]
    at = W.partitionBy(*keys)
    rank = lambda c: F.rank().over(at.orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2
    r = p.select(*keys, rank("prediction").alias("_p"), rank(label).alias("_l"))
    sp, sl = F.stddev_samp("_p"), F.stddev_samp("_l")
    daily = r.groupBy(*keys).agg(F.when((sp > 1e-13) & (sl > 1e-13), F.covar_samp("_p", "_l") / (sp * sl)).otherwise(0.0).alias("ic"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_CODES)
    mean = daily.groupBy(*keys[1:]).agg(F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n_days"))
    base = mean.where("feature IS NULL").select(*([by] if by else []), F.col("ic").alias("_base"))
    some = mean.where("feature IS NOT NULL")
    out = some.join(F.broadcast(base), by) if by else some.crossJoin(F.broadcast(base))  # a single row
    return out.select("feature", *([by] if by else []), (F.col("_base") - F.col("ic")).alias("importance"), "ic", "n_days")


def linear(weights: list[float]) -> Callable[[DataFrame], DataFrame]:
    """predict of a weighted sum."""
    total = lambda: F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return lambda rows: rows.withColumn("prediction", total())
