"""Panels: long tables (date, code, open, high, low, close, volume, amount, vwap, sector) from raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
FIELDS = (*PRICES, "volume", "amount", "vwap", "sector")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_for_nan(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere in the library; NaN from files becomes NULL on the way in."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(kinds[c])) for c in df.columns if kinds[c] in ("double", "float")})


#: Terms are split at this unit, a power of two, so that sums of the coarse parts are exact below 2^53 units (fixed value).
UNIT = 1 / 1024


def steady_sum(x: Column) -> Column:
    """Sum of a double column that doesn't depend on how rows are dealt: coarse parts add up exactly, what is left of the terms is too small for its rounding to show."""
    small = F.abs(x) < 2**53 * UNIT
    coarse = F.rint(x / UNIT) * UNIT
    return F.sum(F.when(small, coarse).otherwise(x)) + F.coalesce(F.sum(F.when(small, x - coarse)), F.lit(0.0))


def bars(ticks: DataFrame, every: str = "day", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Bars of ticks (ts, code, price, size, and the columns in order): first, highest, lowest and last price, summed size and turnover per code and period.

    One grouped aggregate with map-side combination; first and last go by the order columns, so ties can't move them.
    """
    at = F.struct(*order)
    keys = ["code", F.date_trunc(every, "ts").alias("date")]
    out = ticks.groupBy(*keys).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        steady_sum(F.col("size")).alias("volume"), steady_sum(F.col("price") * F.col("size")).alias("amount"),
    )
    if every == "day":
        out = out.withColumn("date", F.to_date("date"))
    return out.withColumn("vwap", F.try_divide("amount", "volume"))


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices per brand; the brand's number modulo 5 is its sector. A line without quantity is no trade."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate").where("l_quantity != 0")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ticks = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("ts"), F.col("p_brand").alias("code"), "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
    )
    out = bars(ticks, "day", ("l_orderkey", "l_linenumber", "price"))
    return out.withColumn("sector", F.pmod(F.regexp_extract("code", r"(\d+)", 1).cast("int"), F.lit(5)))


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event values per user; sizes come from the events' properties."""
    e = table(spark, sf_dir, "events")
    ticks = e.select("ts", "event_id", F.col("user_id").alias("code"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("double") + 1).alias("size"))
    return bars(ticks, "day", ("ts", "event_id")).withColumn("sector", F.pmod(F.col("code"), F.lit(5)).cast("int"))


BRAND_PANEL_SQL = r"""
panel AS (
  SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date,
    arg_min(price, (l_orderkey, l_linenumber, price)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (l_orderkey, l_linenumber, price)) AS close,
    sum(l_quantity) AS volume, sum(price * l_quantity) AS amount, sum(price * l_quantity) / sum(l_quantity) AS vwap,
    CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) % 5 AS sector
  FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0)
  GROUP BY ALL)"""

USER_PANEL_SQL = r"""
panel AS (
  SELECT user_id AS code, CAST(ts AS DATE) AS date,
    arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
    sum(size) AS volume, sum(value * size) AS amount, sum(value * size) / nullif(sum(size), 0) AS vwap, CAST(user_id % 5 AS INT) AS sector
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size FROM events)
  GROUP BY ALL)"""


def check_prices(df: DataFrame, strategy: str = "drop") -> DataFrame:
    """Rows whose high and low don't enclose open and close, or with a price of 0 or less: dropped, flagged (column bad) or an error at run time."""
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    for p in PRICES:
        bad = bad | (F.col(p) <= 0)
    bad = F.coalesce(bad, F.lit(False))
    if strategy == "drop":
        return df.where(~bad)
    if strategy == "flag":
        return df.withColumn("bad", bad)
    return df.withColumn("close", F.when(bad, F.raise_error(F.concat(F.lit("prices don't fit: "), F.col("code").cast("string")))).otherwise(F.col("close")))
