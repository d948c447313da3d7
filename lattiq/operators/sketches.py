"""Aggregates of one's own that merge: tasks keep a small state per key, states meet in a tree, and the result doesn't depend on how rows are dealt."""

from __future__ import annotations

import math
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of tasks in which a key's states meet first.
FAN = 64
#: Keys whose states a task holds before it hands them on.
HELD = 50_000


class Aggregate(Protocol):
    """A state is an array of doubles. add: the state of some values; merge: of two states, in any order; result: what it says, by column (all doubles)."""

    columns: list[str]

    def add(self, values: np.ndarray) -> np.ndarray: ...

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def result(self, state: np.ndarray) -> list[float | None]: ...


class Quantiles:
    """Quantiles of positive numbers within a relative error, from counts by logarithmic bucket: a state holds bucket numbers and counts. Numbers of 0 and less count as 0."""

    def __init__(self, at: list[float], error: float = 0.01):
        self.at, self.base = at, (1 + error) / (1 - error)
        self.columns = [f"q{round(100 * q)}" for q in at]

    def add(self, values: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            bucket = np.where(values > 0, np.ceil(np.log(np.maximum(values, 1e-300)) / math.log(self.base)), -np.inf)
        k, n = np.unique(bucket, return_counts=True)
        return np.concatenate([k, n])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k, n = (np.concatenate([s[: len(s) // 2] if first else s[len(s) // 2 :] for s in (a, b)]) for first in (True, False))
        keys, which = np.unique(k, return_inverse=True)
        return np.concatenate([keys, np.bincount(which, n)])

    def result(self, state: np.ndarray) -> list[float | None]:
        k, n = np.split(state, 2)
        upto = np.cumsum(n)
        places = [min(int(np.searchsorted(upto, q * (upto[-1] - 1), side="right")), len(k) - 1) for q in self.at]
        return [0.0 if np.isneginf(k[p]) else float(2 * self.base ** k[p] / (self.base + 1)) for p in places]


class Moments:
    """n, mean, sd, skew and excess kurtosis from central moments, which merge without losing digits to large means."""

    columns = ["n", "mean", "sd", "skew", "kurtosis"]

    def add(self, values: np.ndarray) -> np.ndarray:
        d = values - values.mean()
        return np.array([len(values), values.mean(), (d**2).sum(), (d**3).sum(), (d**4).sum()])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (na, ma, a2, a3, a4), (nb, mb, b2, b3, b4) = a, b
        n, d = na + nb, mb - ma
        m2 = a2 + b2 + d**2 * na * nb / n
        m3 = a3 + b3 + d**3 * na * nb * (na - nb) / n**2 + 3 * d * (na * b2 - nb * a2) / n
        m4 = a4 + b4 + d**4 * na * nb * (na**2 - na * nb + nb**2) / n**3 + 6 * d**2 * (na**2 * b2 + nb**2 * a2) / n**2 + 4 * d * (na * b3 - nb * a3) / n
        return np.array([n, ma + d * nb / n, m2, m3, m4])

    def result(self, state: np.ndarray) -> list[float | None]:
        n, mean, m2, m3, m4 = state
        flat = m2 <= 0
        return [float(n), float(mean), math.sqrt(m2 / (n - 1)) if n > 1 else None, None if flat else float(math.sqrt(n) * m3 / m2**1.5), None if flat else float(n * m4 / m2**2 - 3)]


def aggregated(df: DataFrame, keys: list[str], value: str, of: Aggregate) -> DataFrame:
    """keys and the columns of the aggregate, over the values that aren't null. A key with no value has no row.

    Each task makes a state per key and batch and merges its own; of a key's states those of every FAN-th task meet in one group, and their results in another, so a hot key is never one group of rows.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    state = f"{kinds}, part int, state array<double>"
    names = [*keys, "part", "state"]

    def out(held: dict, schema: pa.Schema) -> pa.RecordBatch:
        part = TaskContext.get().partitionId() % FAN
        columns = [pa.array([k[i] for k in held], schema.field(n).type) for i, n in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names)

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            values = np.asarray(batch.column("_value"), float)
            place = {k: i for i, k in enumerate(dict.fromkeys(rows))}
            code = np.fromiter((place[r] for r in rows), np.int64, len(rows))
            order = np.argsort(code, kind="stable")
            for key, part in zip(place, np.split(values[order], np.cumsum(np.bincount(code, minlength=len(place)))[:-1]), strict=True):
                s = of.add(part)
                held[key] = of.merge(held[key], s) if key in held else s
            if len(held) >= HELD:
                yield out(held, schema)
                held = {}
        if held:
            yield out(held, schema)

    def merged(table: pa.Table) -> np.ndarray:
        total = None
        for s in table.column("state").to_pylist():
            total = np.array(s) if total is None else of.merge(total, np.array(s))
        return total

    def meet(table: pa.Table) -> pa.Table:
        return pa.table([*(table.column(n).slice(0, 1) for n in names[:-1]), pa.array([merged(table)], pa.list_(pa.float64()))], names)

    def finish(table: pa.Table) -> pa.Table:
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), *(pa.array([v], pa.float64()) for v in of.result(merged(table)))], [*keys, *of.columns])

    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    states = rows.mapInArrow(partial, state).groupBy(*keys, "part").applyInArrow(meet, state)
    return states.groupBy(*keys).applyInArrow(finish, ", ".join([kinds, *(f"{c} double" for c in of.columns)]))
