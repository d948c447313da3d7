"""Readers and writers of panels: files of several layouts with renamed columns, one file per code, hive partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.panel import null_for_nan

#: Column names that files use for the panel's columns (fixed values), in lower case.
ALIASES = {
    "date": ["date", "trade_date", "datetime", "time", "timestamp"], "code": ["code", "symbol", "ticker", "ts_code", "instrument"], "open": ["open", "o"], "high": ["high", "h"], "low": ["low", "l"],
    "close": ["close", "c", "adj_close"], "volume": ["volume", "vol", "v"], "amount": ["amount", "turnover_value", "money"],
}


def rename(df: DataFrame) -> DataFrame:
    """Columns by their panel names, the first alias found wins; others stay. Missing numbers become NULL."""
    have = {c.lower(): c for c in reversed(df.columns)}
    new = {have[a]: name for name, names in ALIASES.items() for a in [next((a for a in names if a in have), None)] if a}
    return null_for_nan(df.select(*(F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns)))


def read_panel(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A panel from parquet, orc, csv or json files. Text formats want a schema (no second pass over the files to guess one); dates are parsed in the formats met in practice."""
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    df = rename((reader.schema(schema) if schema else reader).format(kind).load(path))
    if dict(df.dtypes).get("date") == "string":
        df = df.withColumn("date", F.coalesce(*(F.try_to_timestamp("date", F.lit(f)) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss"))).cast("date"))
    return df


def read_lake(spark: SparkSession, folder: str) -> DataFrame:
    """A lake with one parquet file per code: the code is the file's name."""
    df = spark.read.parquet(f"{folder}/*.parquet").withColumn("code", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.parquet$", 1))
    return rename(df)


def write_panel(panel: DataFrame, path: str, by: str | None = "year") -> None:
    """Parquet in partitions by year of date (readers prune on it), rows of a code together."""
    if by:
        panel = panel.withColumn(by, F.year("date"))
        panel.repartition(by, "code").sortWithinPartitions("code", "date").write.mode("overwrite").partitionBy(by).parquet(path)
    else:
        panel.repartition("code").sortWithinPartitions("code", "date").write.mode("overwrite").parquet(path)
