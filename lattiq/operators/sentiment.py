"""Scores of news and of reported large trades, one row per code. Each is one shuffle on the code; every factor is taken from the same aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def news_scores(news: DataFrame, for_score: int = 20, for_heat: int = 30) -> DataFrame:
    """Mean score of each code's latest for_score articles; heat and divergence of its latest for_heat ones.

    News has code, at, article_id (breaks ties of at), score and source. Heat is log(1 + articles), up to half more for five sources or more; divergence is the population standard deviation of the
    scores, 0 below three articles. Articles without a score count as neutral; an empty or missing source is no source. The number of articles looked at is part of the definition of these factors.
    """
    latest = W.partitionBy("code").orderBy(F.desc("at"), F.desc("article_id"))
    n = news.select("code", "at", "article_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("source") != "", F.col("source")).alias("source")).withColumn("place", F.row_number().over(latest))
    out = n.where(F.col("place") <= max(for_score, for_heat)).groupBy("code").agg(
        F.avg(F.when(F.col("place") <= for_score, F.col("score"))).alias("score"),
        F.count(F.when(F.col("place") <= for_heat, 1)).alias("articles"),
        F.count_distinct(F.when(F.col("place") <= for_heat, F.col("source"))).alias("sources"),
        F.stddev_pop(F.when(F.col("place") <= for_heat, F.col("score"))).alias("spread"),
    )
    heat = F.log1p("articles") * (1 + F.least(F.col("sources") / 5, F.lit(1.0)) * 0.5)
    return out.select("code", "score", heat.alias("heat"), F.when(F.col("articles") >= 3, F.col("spread")).otherwise(0.0).alias("divergence"))


def board_scores(board: DataFrame, days: int = 20) -> DataFrame:
    """Net share of the reported turnover per code over the last `days` reported dates, times log(1 + reports), within -1 and 1.

    Board has code, date, net and deal, and is read twice: once for its dates, of which the first one in range is broadcast (a single row of an aggregate), and once for the sums. Codes without turnover score 0.
    """
    dates = board.select("date").distinct().orderBy(F.desc("date")).limit(days)
    first = dates.agg(F.min("date").alias("first_date"))  # one row
    recent = board.join(F.broadcast(first), F.col("date") >= F.col("first_date"))
    sums = recent.groupBy("code").agg(F.sum(F.coalesce("net", F.lit(0.0))).alias("net"), F.sum(F.coalesce("deal", F.lit(0.0))).alias("deal"), F.count(F.lit(1)).alias("n"))
    ratio = F.when(F.col("deal") > 0, F.col("net") / F.col("deal")).otherwise(0.0)
    return sums.select("code", F.greatest(F.least(ratio * F.log1p("n"), F.lit(1.0)), F.lit(-1.0)).alias("board"))


def seat_score(net: Column, bought: Column, institutions: Column) -> Column:
    """tanh of the net share of what was bought, a tenth more for each institution's seat; missing amounts count as 0."""
    zero = F.lit(0.0)
    return F.tanh(F.coalesce(net, zero) / F.greatest(F.coalesce(bought, zero), F.lit(1.0)) + F.lit(0.1) * F.coalesce(institutions.cast("double"), zero))


def seat_scores(board: DataFrame, latest: int = 5) -> DataFrame:
    """Mean seat score of each code's latest reports. Board has code, date, report_id, net, bought and institutions."""
    place = F.row_number().over(W.partitionBy("code").orderBy(F.desc("date"), F.desc("report_id")))
    recent = board.withColumn("place", place).where(F.col("place") <= latest)
    return recent.groupBy("code").agg(F.avg(seat_score(F.col("net"), F.col("bought"), F.col("institutions"))).alias("seats"))
