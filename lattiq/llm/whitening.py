"""Whitening of embedding vectors. Each partition keeps the singular values, right vectors and mean of its rows in full rank; merges stack two such summaries with a row for the difference of their means and decompose again."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, small_batches, table

#: A vector entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that the query returns.
COMPONENTS = 16
#: Summaries are merged in this many groups, then in fewer.
LEVELS = (1024, 32, 1)
#: Vectors that are decomposed together.
BLOCK = 4096
#: Entries beyond this have no whole number of their own as doubles and count as not finite.
LARGEST = float(1 << 50)
#: An eigenvalue below this share of the largest is zero.
FLAT = 1e-13


@dataclass
class Summary:
    """n vectors: sums of their entries (whole numbers, exact), and the triangle singular values times right vectors, whose Gram matrix is that of the centred vectors."""

    n: int
    sums: list
    triangle: np.ndarray


def _decompose(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of rows, all dimensions kept: a square with the same Gram matrix."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(s)] = s[:, None] * vt
    return out


def summary(x: np.ndarray) -> Summary:
    """Of whole-numbered vectors, one a row."""
    sums = [int(v) for v in x.sum(0)]
    mean = np.array(sums, float) / len(x)
    return Summary(len(x), sums, _decompose(x - mean))


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both: their triangles and the mean-correction row sqrt(na nb / (na + nb)) (mean a - mean b), decomposed again. Nothing is lost: the Gram matrices add up exactly."""
    if not a.n or not b.n:
        return a if a.n else b
    gap = np.array([(x * b.n - y * a.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums, strict=True)])  # whole numbers until they are divided
    row = np.sqrt(a.n * b.n / (a.n + b.n)) * gap
    return Summary(a.n + b.n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], _decompose(np.vstack([a.triangle, b.triangle, row])))


_SUMMARY = "part long, n long, sums array<string>, triangle array<double>"


def _to_arrow(part: int, s: Summary):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([s.n], pa.int64()), pa.array([[str(v) for v in s.sums]], pa.list_(pa.string())), pa.array([s.triangle.ravel()], pa.list_(pa.float64()))], ["part", "n", "sums", "triangle"]
    )


def _from_row(row: dict) -> Summary:
    d = len(row["sums"])
    return Summary(row["n"], [int(v) for v in row["sums"]], np.array(row["triangle"], float).reshape(d, d))


def whole_vectors(df: DataFrame, vector_col: str) -> DataFrame:
    """df with x (array of longs, without SHIFT) for the rows that have a full, finite and not empty vector of the commonest length; ties go to the shorter."""
    v = F.col(vector_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST / SCALE, F.lit(False)))
    rows = df.where(F.coalesce(fine, F.lit(False))).withColumn("x", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (length.d if length else 0))


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x once. Copies are merged in each task before they are shuffled."""
    return rows.select("x").distinct()


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def summarise(fit: DataFrame) -> Summary | None:
    """The summary of all of fit (x): one per partition, merged in a tree of LEVELS. One summary, as large as the dimension squared, reaches the driver."""
    import pyarrow as pa

    def leaves(batches):
        from pyspark import TaskContext

        total, held, n = None, [], 0

        def take(total, held):
            found = summary(np.concatenate(held))
            return merge(total, found) if total else found

        for batch in batches:
            if batch.num_rows:
                held.append(_matrix(batch.column("x")))
                n += batch.num_rows
            if n >= BLOCK:
                total, held, n = take(total, held), [], 0
        if held:
            total = take(total, held)
        if total:
            yield _to_arrow(TaskContext.get().partitionId(), total)

    def merged(group):
        total = None
        for batch in group.to_batches(max_chunksize=8):
            for row in batch.to_pylist():
                total = merge(total, _from_row(row)) if total else _from_row(row)
        return pa.Table.from_batches([_to_arrow(group.column("part")[0].as_py(), total)])

    level = fit.mapInArrow(leaves, _SUMMARY)
    for groups in LEVELS:
        level = level.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(merged, _SUMMARY)
    found = level.collect()  # one row
    return _from_row(found[0].asDict()) if found else None


@dataclass
class Whitener:
    """mean: sums and n as whole numbers; components: unit vectors, one a row, by falling eigenvalue; values: eigenvalues; trace: of the covariance."""

    n: int
    sums: list
    components: np.ndarray
    values: np.ndarray
    trace: float


def fit(vectors: DataFrame, components: int | None = None) -> Whitener | None:
    """Components of x over its rows, as many as asked for or dimensions there are. Signs make each vector's largest entry positive. None without rows."""
    found = summarise(vectors)
    if found is None or not found.sums:
        return None
    _, s, vt = np.linalg.svd(found.triangle)
    vt = vt * np.sign(vt[np.arange(len(vt)), np.argmax(np.abs(vt), 1)])[:, None]
    values = s**2 / found.n
    k = min(components or len(values), len(values))
    return Whitener(found.n, found.sums, vt[:k], values[:k], float(values.sum()))


def _projected(w: Whitener, x: np.ndarray) -> np.ndarray:
    """Rows centred, projected and divided by the eigenvalues' roots; 0 along components of no variance."""
    centred = (x * w.n - np.array(w.sums, np.int64)) / w.n if _small(w, x) else np.array([[(int(v) * w.n - s) / w.n for v, s in zip(row, w.sums, strict=True)] for row in x], float)
    full = w.values > FLAT * max(w.values[0], 1e-300)
    return (centred @ w.components.T) / np.sqrt(np.where(full, w.values, 1)) * full


def _small(w: Whitener, x: np.ndarray) -> bool:
    """True if n x - S stays within 62 bits."""
    return float(np.abs(x).max(initial=0)) * w.n * 2 < 2**62


def _deviation(w: Whitener, x: np.ndarray) -> list:
    """Exact sums over dimensions of (n x - S)^2; None where a long can't hold it."""
    if _small(w, x):
        gap = x * w.n - np.array(w.sums, np.int64)
        if len(w.sums) * float(np.abs(gap).max(initial=0)) ** 2 < 2**62:
            return [int(v) for v in (gap * gap).sum(1)]
    out = [sum((int(v) * w.n - s) ** 2 for v, s in zip(row, w.sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in out]


def identity_error(fit_rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components of some variance. Partitions add up sums and products of projections; their number is bounded by the components squared."""
    import pyarrow as pa

    def run(batches):
        k = len(w.values)
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            if batch.num_rows:
                p = np.hstack([_projected(w, _matrix(batch.column("x"))), np.ones((batch.num_rows, 1))])
                total += p.T @ p
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    found = fit_rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")
    k = len(w.values)
    total = found["value"].to_numpy().reshape(k + 1, k + 1) / w.n
    full = w.values > FLAT * max(w.values[0], 1e-300)
    error = np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k))[np.ix_(full, full)]
    return float(error.max(initial=0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector: id, n, deviation, whitened (array of doubles, a component each), explained (array), identity_error.

    Rows whose vector is null, holds null, nan, infinite or huge (over LARGEST) entries, or has another length than most are dropped. Equal rows and rows with null or repeated ids are each returned and
    enter the fit once per distinct vector. Components without variance whiten to 0; deviation is null where no long can hold it. An empty table, or one of empty vectors, gives no rows. Other columns are not read.
    """
    import pyarrow as pa

    small_batches(df.sparkSession)
    written = Written(df.sparkSession)
    try:
        rows = whole_vectors(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v").select("id", "x")
        fit_rows = written.cut(fit_list(rows))
        w = fit(fit_rows, components)
        schema = f"id {rows.schema['id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
        if w is None:
            return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
        error = identity_error(fit_rows, w)

        def run(batches):
            explained = (w.values / w.trace if w.trace else np.zeros(len(w.values))).tolist()
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, n = _matrix(batch.column("x")), batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([w.n] * n, pa.int64()), pa.array(_deviation(w, x), pa.int64()), pa.array(list(_projected(w, x)), pa.list_(pa.float64())), pa.array([explained] * n, pa.list_(pa.float64())), pa.array([error] * n)],
                    ["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    finally:
        written.drop()


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    found = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("_k", "_v"))
    return found.select("vec_id", (F.col("_k") + 1).alias("component"), "n", "deviation", F.col("_v.whitened").alias("whitened"), F.col("_v.explained").alias("explained"), "identity_error")
