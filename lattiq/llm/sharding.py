"""Rendezvous (highest random weight) sharding of records by a stable key, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SHARDS = 16
#: Rows that one slot-numbering bucket holds on average.
BUCKET_ROWS = 100_000
#: Equal rows that are numbered from one list.
RUN = 4096


def owner(key: Column, weights: list[float]) -> Column:
    """The shard that wins the key: the least -ln(u) / weight, with u uniform by the hash of key and shard.

    A further shard can only take keys for itself, as the other shards' costs stay; a shard gets keys in proportion to its weight.
    """
    costs = []
    for shard, weight in enumerate(weights):
        if weight <= 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
        costs.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*costs))["shard"]


def shard(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: list[float] | None = None, grown: list[float] | None = None) -> DataFrame:
    """One row per record: key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard.

    Key and shard weights alone decide. A null key counts as the key "null"; a null text has size 1 and the checksum of no bytes; repeated rows share a shard and get slots of their own.
    An empty table gives no rows. Other columns are not read. slot numbers the rows of a shard from 0 without gaps: rows are numbered inside hash buckets of a shard, of
    about BUCKET_ROWS rows, and the buckets' counts are summed up, so no task holds a whole shard. Equal rows are counted first and numbered together, so a key that repeats very often is no
    task of its own.
    """
    weights = weights or [1.0] * SHARDS
    grown = grown or [*weights, 1.0]
    buckets = max(1, math.ceil(df.count() / (len(weights) * BUCKET_ROWS)))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    at = df.select(F.col(key_col).alias("_id"), key.alias("_key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    at = at.groupBy("_id", "_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    at = at.withColumns({"shard": owner(F.col("_key"), weights), "grown_shard": owner(F.col("_key"), grown), "_bucket": F.pmod(F.xxhash64("_key", "size", "text_crc32", F.lit("slot")), F.lit(buckets))})
    upto = lambda by, order: by.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counts = at.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_rows"))
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("_rows").over(upto(W.partitionBy("shard"), ["_bucket"])), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_n").over(upto(W.partitionBy("shard", "_bucket"), ["_key", "text_crc32", "size"])), F.lit(0))
    rows = at.withColumn("_inside", inside).join(counts, ["shard", "_bucket"]).withColumn("_first", F.col("_before") + F.col("_inside"))
    # a row for each of equal ones, in two steps so that no long list is held
    rows = rows.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.col("_from"), F.least(F.col("_n") - 1, F.col("_from") + RUN - 1))))
    return rows.select(F.col("_id").alias(key_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_i")).cast("long").alias("slot"), "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
