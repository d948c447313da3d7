"""Clusters of items from a table of their distances: average linkage by rounds in which all pairs that are each other's nearest merge at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import cut


def average_linkage(distances: DataFrame, items: DataFrame, limit: float, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """distances (a, b, distance; each pair once), items (item) -> (item, cluster: its least item), and the merges (a, b, height, round).

    Clusters merge while their mean distance is `limit` or less, nearest first; pairs that have no row are too far apart to merge. Under average linkage a merge never brings a third cluster nearer than both of its parts
    were, so pairs that are nearest to each other can merge in the same round with the result of one merge at a time; ties go by the items. A round is one join and one grouping of the distances between clusters, and rounds grow
    with the logarithm of the items, as a rule.
    """
    spark = items.sparkSession
    item = items.select("item").distinct()
    member = cut(item.select("item", F.col("item").alias("cluster")))
    kind = items.schema["item"].dataType.simpleString()
    lo, hi = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    table = cut(distances.where("a != b AND distance IS NOT NULL").select(lo, hi, F.col("distance").cast("double").alias("total")).groupBy("a", "b").agg(F.avg("total").alias("total")))
    size = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = table.select("a", "b", "total", F.lit(1).cast("long").alias("known"))
    merges = spark.createDataFrame([], f"a {kind}, b {kind}, height double, round int")
    for k in range(most_rounds):
        sizes = size.select(F.col("cluster").alias("_c"), "n")
        wide = pairs.join(sizes.withColumnRenamed("n", "na"), F.col("a") == F.col("_c")).drop("_c").join(sizes.withColumnRenamed("n", "nb"), F.col("b") == F.col("_c")).drop("_c")
        wide = wide.where(F.col("known") == F.col("na") * F.col("nb"))  # a pair of items without a distance keeps their clusters apart
        pick = F.struct((F.col("total") / F.col("known")).alias("height"), "a", "b")
        near = wide.select("a", "b", pick.alias("p")).where(F.col("p.height") <= limit)
        best = near.select(F.col("a").alias("c"), "p").unionByName(near.select(F.col("b").alias("c"), "p")).groupBy("c").agg(F.min("p").alias("p"))
        both = cut(best.groupBy("p").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select("p.a", "p.b", "p.height", F.lit(k).alias("round")))
        if both.isEmpty():
            break
        merges = cut(merges.unionByName(both))
        into = both.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
        member = cut(member.join(into, F.col("cluster") == F.col("_from"), "left").select("item", F.coalesce("_to", "cluster").alias("cluster")))
        size = member.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        moved = lambda df, c: df.join(into, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")  # noqa: B023, E731
        pairs = moved(moved(pairs, "a"), "b").where("a != b").groupBy(lo, hi).agg(F.sum("total").alias("total"), F.sum("known").alias("known"))
        pairs = cut(pairs)
    return member, merges
