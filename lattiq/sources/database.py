"""A Spark data source for tables of a DuckDB file on a shared path: filters reach the reader, and each partition reads a range of the table's rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _name(parts: tuple[str, ...]) -> str:
    return ".".join('"' + p.replace('"', '""') + '"' for p in parts)


def _condition(f: Filter) -> tuple[str, list] | None:
    """SQL of a filter with its values as parameters; None if the reader can't take it."""
    if type(f) in _SIGNS:
        return f"{_name(f.attribute)} {_SIGNS[type(f)]} ?", [f.value]
    if isinstance(f, In):
        return f"{_name(f.attribute)} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, IsNull | IsNotNull):
        return f"{_name(f.attribute)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
    if isinstance(f, StringStartsWith):
        return f"starts_with({_name(f.attribute)}, ?)", [f.value]
    return None


class Rows(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class TableReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], partitions: int):
        self.path, self.table, self.columns, self.n = path, table, columns, partitions
        self.where: list[str] = []
        self.values: list = []

    def _open(self):
        import duckdb

        return duckdb.connect(self.path, read_only=True)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            found = _condition(f)
            if found is None:
                yield f  # Spark applies it
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[Rows]:
        with self._open() as con:
            last = con.execute(f"SELECT max(rowid) FROM {_name((self.table,))}").fetchone()[0]
        if last is None:
            return [Rows(0, 0)]
        step = -(-(last + 1) // self.n)
        return [Rows(low, low + step) for low in range(0, last + 1, step)]

    def read(self, partition: Rows):
        low, high = partition.value
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with self._open() as con:
            found = con.sql(f"SELECT {', '.join(_name((c,)) for c in self.columns)} FROM {_name((self.table,))} WHERE {where}", params=[low, high, *self.values])
            yield from found.to_arrow_reader(10_000)


class DatabaseTable(DataSource):
    """Format "duckdb_table"; options path (of the file, on a path that all executors share), table, partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "duckdb_table"

    def schema(self):
        import duckdb
        from pyspark.sql.pandas.types import from_arrow_schema

        with duckdb.connect(self.options["path"], read_only=True) as con:
            return from_arrow_schema(con.sql(f"SELECT * FROM {_name((self.options['table'],))} LIMIT 0").to_arrow_reader(1).schema)

    def reader(self, schema) -> TableReader:
        return TableReader(self.options["path"], self.options["table"], schema.names, int(self.options.get("partitions", "8")))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("duckdb_table") known and lets filters through to it."""
    spark.dataSource.register(DatabaseTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
