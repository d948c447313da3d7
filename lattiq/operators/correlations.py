"""Correlations of all pairs of many columns or codes, mean by day or over trailing windows, from moments by blocks of columns.

A row's values are one array, cut into blocks of BLOCK columns; each pair of blocks of a date is a group of its own, whose moments are a few matrix products. Neither the plan nor a group grows with the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns of a block, dates of a stretch of windows at least, pairs of values that a correlation needs at least, and what a deviation must exceed.
BLOCK, STRETCH, FEWEST, FLAT = 32, 256, 5, 1e-13
#: Moments of a pair: number, sums of either side, of squares, of products.
_MOMENTS = 6


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 inside each column, ties by their mean, missing values left out."""
    out = np.full(x.shape, np.nan)
    for k in range(x.shape[1]):
        there = np.flatnonzero(~np.isnan(x[:, k]))
        _, which, n = np.unique(x[there, k], return_inverse=True, return_counts=True)
        last = np.cumsum(n)
        out[there, k] = (last - (n - 1) / 2)[which]
    return out


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The moments of every column of x with every column of y, over rows that have both."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y, mx, my = np.where(mx, x, 0), np.where(my, y, 0), mx.astype(float), my.astype(float)
    return np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])


def _of_moments(m: np.ndarray) -> np.ndarray:
    """Correlations; missing where a side doesn't vary."""
    with np.errstate(all="ignore"):
        n = m[0]
        vx, vy, c = (m[3] - m[1] * m[1] / n) / (n - 1), (m[4] - m[2] * m[2] / n) / (n - 1), (m[5] - m[1] * m[2] / n) / (n - 1)
        sx, sy = np.sqrt(np.maximum(vx, 0)), np.sqrt(np.maximum(vy, 0))
        return np.where((n > 1) & (sx > FLAT) & (sy > FLAT), c / (sx * sy), np.nan)


def _daily_moments(rows: DataFrame, names: int, ranked: bool, date: str) -> DataFrame:
    """rows (date, v: array of so many doubles) -> date, i, j (blocks, i <= j), m: the moments of their columns over the rows of the date."""
    blocks = -(-names // BLOCK)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks * (blocks + 1) // 2 - 1)), lambda k: k)
    # the pairs of blocks in a row: k counts 0-0, 0-1, 1-1, 0-2, 1-2, 2-2, ...
    j = F.floor((F.sqrt(8.0 * F.col("_k") + 1) - 1) / 2 + 1e-9).cast("int")
    own = rows.select(date, "v", F.explode(pairs).alias("_k")).select(date, "v", "_k", j.alias("j")).withColumn("i", (F.col("_k") - F.expr("j * (j + 1) / 2")).cast("int"))
    cut = lambda b: F.slice("v", F.col(b) * BLOCK + 1, F.lit(BLOCK))
    own = own.select(date, "i", "j", cut("i").alias("x"), cut("j").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        x, y = (np.array(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1) for c in ("x", "y"))
        if ranked:
            x, y = _average_ranks(x), _average_ranks(y)
        return pa.table([table.column(date).slice(0, 1), table.column("i").slice(0, 1), table.column("j").slice(0, 1), pa.array([_moments(x, y).ravel()], pa.list_(pa.float64()))], [date, "i", "j", "m"])

    kind = rows.schema[date].dataType.simpleString()
    return own.groupBy(date, "i", "j").applyInArrow(run, f"{date} {kind}, i int, j int, m array<double>")


def _pairs_of(i: int, j: int, names: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each entry of a pair of blocks' matrix."""
    a, b = np.meshgrid(*(np.arange(k * block, min((k + 1) * block, names)) for k in (i, j)), indexing="ij")
    return a, b


def daily_correlations(rows: DataFrame, names: int, ranked: bool = True, date: str = "date") -> DataFrame:
    """rows (date, v) -> date, a, b (places of two columns in v, a < b), n, corr: over the rows of the date that have both values. Pairs in which one side doesn't vary on the date are left out."""
    m, block = _daily_moments(rows, names, ranked, date), BLOCK

    def run(batches):
        for batch in batches:
            for d, i, j, data in zip(*(batch.column(k) for k in range(4)), strict=True):
                i, j = i.as_py(), j.as_py()
                a, b = _pairs_of(i, j, names, block)
                of = np.array(data.values.to_numpy(), float).reshape(_MOMENTS, *a.shape)
                c = _of_moments(of)
                ok = (a < b) & ~np.isnan(c)
                yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * int(ok.sum()), batch.column(0).type), pa.array(a[ok].astype(np.int32)), pa.array(b[ok].astype(np.int32)), pa.array(of[0][ok].astype(np.int64)), pa.array(c[ok])], [date, "a", "b", "n", "corr"])

    kind = rows.schema[date].dataType.simpleString()
    return m.mapInArrow(run, f"{date} {kind}, a int, b int, n long, corr double")


def rolling_correlations(rows: DataFrame, names: int, window: int = 60, ranked: bool = True, ends: DataFrame | None = None, date: str = "date") -> DataFrame:
    """rows (date, v) -> date, a, b, n, corr: over all rows of the last `window` dates up to each (ranked: ranks are taken inside a date). ends (date): only windows that end there.

    The moments of a date are taken once; windows are running sums of them, stretch by stretch of dates, so no group holds more than a stretch and the window before it of one pair of blocks. Windows that are not full, and
    pairs with under FEWEST rows or a side that doesn't vary, are left out.
    """
    m = _daily_moments(rows, names, ranked, date)
    days = rows.select(date).distinct().select(date, F.row_number().over(W.orderBy(date)).alias("t"))  # a row a date
    if ends is not None:
        days = days.join(ends.select(F.col(date).alias("_end")).distinct(), F.col(date) == F.col("_end"), "left")
    days = days.select(F.col(date).alias("_d"), "t", (F.lit(True) if ends is None else F.col("_end").isNotNull()).alias("wanted"))
    size, block = max(STRETCH, window), BLOCK
    at = F.floor((F.col("t") - 1) / size).cast("int")
    reach = F.floor((F.col("t") + window - 2) / size).cast("int")  # a date also counts in the windows that follow it
    m = m.join(F.broadcast(days), F.col(date) == F.col("_d")).withColumn("stretch", F.explode(F.sequence(at, reach)))

    def run(table: pa.Table) -> pa.Table:
        i, j, stretch = (table.column(c)[0].as_py() for c in ("i", "j", "stretch"))
        a, b = _pairs_of(i, j, names, block)
        t = np.array(table.column("t"))
        order = np.argsort(t)
        data, dates, wanted = table.column("m").combine_chunks(), table.column(date).combine_chunks(), np.array(table.column("wanted"))
        width = _MOMENTS * a.size
        held = np.array(data.flatten().to_numpy(), float).reshape(-1, width)
        total, first = np.zeros(width), 0
        out: list[list] = [[], [], [], [], []]
        for k in order:
            total = total + held[k]
            while t[order[first]] <= t[k] - window:
                total = total - held[order[first]]
                first += 1
            if t[k] < window or (t[k] - 1) // size != stretch or not wanted[k]:
                continue
            of = total.reshape(_MOMENTS, *a.shape)
            c = np.where(of[0] > FEWEST - 0.5, _of_moments(of), np.nan)
            ok = (a < b) & ~np.isnan(c)
            for x, v in zip(out, (np.full(int(ok.sum()), k), a[ok], b[ok], np.rint(of[0][ok]), c[ok]), strict=True):
                x.append(v)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([dates.take(pa.array(cols[0].astype(np.int64))), *(pa.array(x.astype(k)) for x, k in zip(cols[1:], (np.int32, np.int32, np.int64, float), strict=True))], [date, "a", "b", "n", "corr"])

    kind = rows.schema[date].dataType.simpleString()
    return m.select(date, "i", "j", "m", "t", "wanted", "stretch").groupBy("stretch", "i", "j").applyInArrow(run, f"{date} {kind}, a int, b int, n long, corr double")


def columns_as_rows(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """date, v: the columns of each row as one array."""
    return df.select(date, F.array(*(F.col(c).cast("double") for c in columns)).alias("v"))


def codes_as_rows(df: DataFrame, value: str, codes: list, date: str = "date", code: str = "code", aligned: bool = False) -> DataFrame:
    """date, v: the values of all codes (as many as listed) on each date as one array, missing ones NULL; aligned: only dates that have all of them."""
    place = F.create_map(*(x for k, c in enumerate(codes) for x in (F.lit(c), F.lit(k))))
    rows = df.where(F.col(value).isNotNull()).select(date, place[F.col(code)].alias("_k"), F.col(value).cast("double").alias("_x")).where("_k IS NOT NULL")
    rows = rows.groupBy(date).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_m"))
    rows = rows.where(F.size("_m") == len(codes)) if aligned else rows
    return rows.select(date, F.transform(F.sequence(F.lit(0), F.lit(len(codes) - 1)), lambda k: F.try_element_at("_m", k)).alias("v"))


def named(pairs: DataFrame, names: list) -> DataFrame:
    """a and b by name."""
    of = F.array(*(F.lit(n) for n in names))
    return pairs.withColumns({"a": F.element_at(of, F.col("a") + 1), "b": F.element_at(of, F.col("b") + 1)})


def factor_correlation(df: DataFrame, factors: list[str], date: str = "date") -> DataFrame:
    """a, b, corr, n_days: mean over dates of the daily rank correlation of each pair of factors."""
    daily = daily_correlations(columns_as_rows(df, factors, date), len(factors), True, date)
    return named(daily.groupBy("a", "b").agg(F.avg("corr").alias("corr"), F.count(F.lit(1)).alias("n_days")), factors)


def rolling_factor_correlation(df: DataFrame, factors: list[str], window: int = 60, ranked: bool = True, ends: DataFrame | None = None, date: str = "date") -> DataFrame:
    """date, a, b, n, corr of each pair of factors over the codes of the last `window` dates."""
    return named(rolling_correlations(columns_as_rows(df, factors, date), len(factors), window, ranked, ends, date), factors)


def rolling_code_correlation(df: DataFrame, value: str, codes: list, window: int = 60, ends: DataFrame | None = None, aligned: bool = False, date: str = "date", code: str = "code") -> DataFrame:
    """date, a, b, n, corr of the values (returns) of each pair of codes over the last `window` dates that any code has; aligned: that all codes have."""
    return named(rolling_correlations(codes_as_rows(df, value, codes, date, code, aligned), len(codes), window, False, ends, date), codes)


def correlation_matrix(df: DataFrame, value: str, codes: list, window: int = 60, ranked: bool = False, date: str = "date", code: str = "code") -> DataFrame:
    """a, b, corr, n: of each two codes over the last `window` dates that all codes have (fewer if there are no more, two at least); 0 where a side doesn't vary. ranked: ranks of each code's own values in the window."""
    rows = codes_as_rows(df, value, codes, date, code, True)
    last = rows.select(date).orderBy(F.desc(date)).limit(window)
    rows, block = rows.join(F.broadcast(last), date, "left_semi"), BLOCK

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = (np.array(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(table.num_rows, -1) for c in ("x", "y"))
        if ranked:
            x, y = _average_ranks(x), _average_ranks(y)
        a, b = _pairs_of(i, j, len(codes), block)
        of = _moments(x - x.mean(0), y - y.mean(0))
        ok = (a < b) & (of[0] > 1)
        return pa.table([pa.array(a[ok].astype(np.int32)), pa.array(b[ok].astype(np.int32)), pa.array(np.nan_to_num(_of_moments(of))[ok]), pa.array(of[0][ok].astype(np.int64))], ["a", "b", "corr", "n"])

    blocks = -(-len(codes) // BLOCK)
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.transform(F.sequence(i, F.lit(blocks - 1)), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    own = rows.select("v", at.alias("_b")).select("_b.i", "_b.j", "v")
    cut = lambda b: F.slice("v", F.col(b) * BLOCK + 1, F.lit(BLOCK))
    return named(own.select("i", "j", cut("i").alias("x"), cut("j").alias("y")).groupBy("i", "j").applyInArrow(run, "a int, b int, corr double, n long"), codes)
