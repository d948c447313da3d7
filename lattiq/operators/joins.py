"""Joins that Spark has no operator for: as-of, decayed range joins, first-in-first-out lot matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, left_at: str, right_at: str, columns: list[str], prefix: str = "") -> DataFrame:
    """left with, from the latest row of right at or before it (same `by`), the named columns; NULL where there is none.

    Both sides go through one shuffle by key and one sort; the value is carried forward by a running window, so no pair of rows is ever formed. Of right rows at one time the last by the
    columns' order counts. A row of right whose time is NULL never matches.
    """
    r = right.where(F.col(right_at).isNotNull()).select(F.col(by), F.col(right_at).alias("_at"), F.struct(*columns).alias("_right"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema[left_at].dataType).alias("_own"))
    rest = F.struct(*left.columns).alias("_left")
    ls = left.select(F.col(by), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), rest)
    both = ls.unionByName(r.drop("_own"), allowMissingColumns=True)
    run = W.partitionBy(by).orderBy("_at", "_side", F.col("_right")).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_match", F.last("_right", ignorenulls=True).over(run)).where("_side = 1")
    return found.select("_left.*", *(F.col(f"_match.{c}").alias(prefix + c) for c in columns))


def decayed_events(bars: DataFrame, events: DataFrame, by: str, bar_at: str, event_at: str, score: Column, lookback: int, decay: float) -> DataFrame:
    """Per bar: sum of score * exp(-decay * age in days) over its key's events of the last `lookback` days (bar's day included, clipped to [-1, 1]), and their number.

    The range condition becomes an equality: each event is copied to the days that can see it (lookback of them) and summed there, so the join is on (key, day) and grows with
    lookback times the events, never with events times bars.
    """
    e = events.select(F.col(by).alias("_by"), F.to_date(event_at).alias("_day"), score.alias("_score"))
    seen = e.select("_by", "_day", "_score", F.posexplode(F.sequence("_day", F.date_add("_day", lookback - 1))).alias("_age", "_on"))
    per = seen.groupBy("_by", "_on").agg(F.sum(F.col("_score") * F.exp(F.lit(-decay) * F.col("_age"))).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    out = bars.join(per, (F.col(by) == F.col("_by")) & (F.to_date(bar_at) == F.col("_on")), "left")
    score_col = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_sum", F.lit(0.0))))
    return out.select(*bars.columns, score_col.alias("event_score"), F.coalesce("_n", F.lit(0)).alias("event_count"))


def fifo_lots(trades: DataFrame, by: str = "symbol", at: str = "datetime", tie: str = "trade_id") -> DataFrame:
    """Round trips: sells (side 'sell') matched with the oldest open buys of their symbol, in parts where needed; what a sell exceeds the open lots by is dropped.

    Lots become intervals of cumulative quantity: a buy covers [b0, b1), a sell's filled part [s0, s1), and they match where the intervals overlap. Both sides are merged by a sorted pass
    per symbol: boundaries of both are put in order, and each elementary interval looks up its buy and its sell by running windows, so no buy x sell pairs arise.
    """
    w = W.partitionBy(by).orderBy(at, tie)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    t = trades.withColumn("_signed", F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")))
    t = t.withColumn("_cum", F.sum("_signed").over(run))
    # stock that was never there: how far the running sum has gone below zero so far
    t = t.withColumn("_short", F.greatest(F.lit(0.0), -F.min("_cum").over(run)))
    t = t.withColumn("_filled", F.when(F.col("side") == "buy", F.col("quantity")).otherwise(F.col("quantity") - (F.col("_short") - F.coalesce(F.lag("_short").over(w), F.lit(0.0)))))
    side = W.partitionBy(by, "side").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_end", F.sum("_filled").over(side)).withColumn("_start", F.col("_end") - F.col("_filled")).where("_filled > 0")
    lot = F.struct(F.col(at).alias("at"), F.col("price"), F.col("quantity"), F.col("fee"), F.col(tie).alias("id"), F.col("_end").alias("end"))
    buys = t.where("side = 'buy'").select(by, F.col("_start").alias("_edge"), lot.alias("buy"), F.lit(None).cast(t.select(lot.alias("x")).schema[0].dataType).alias("sell"))
    sells = t.where("side != 'buy'").select(by, F.col("_start").alias("_edge"), F.lit(None).cast(t.select(lot.alias("x")).schema[0].dataType).alias("buy"), lot.alias("sell"))
    edges = buys.unionByName(sells).groupBy(by, "_edge").agg(F.max("buy").alias("buy"), F.max("sell").alias("sell"))
    order = W.partitionBy(by).orderBy("_edge")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    e = edges.select(by, F.col("_edge"), F.last("buy", ignorenulls=True).over(upto).alias("buy"), F.last("sell", ignorenulls=True).over(upto).alias("sell"), F.lead("_edge").over(order).alias("_next"))
    stop = F.least(F.coalesce("_next", F.lit(float("inf"))), F.col("buy.end"), F.col("sell.end"))
    e = e.withColumn("matched", stop - F.col("_edge")).where("matched > 0 AND buy IS NOT NULL AND sell IS NOT NULL")
    fees = F.col("buy.fee") * F.col("matched") / F.col("buy.quantity") + F.col("sell.fee") * F.col("matched") / F.col("sell.quantity")
    return e.select(
        by, F.col("buy.id").alias("buy_id"), F.col("sell.id").alias("sell_id"), F.col("buy.at").alias("buy_at"), F.col("sell.at").alias("sell_at"), "matched",
        F.col("buy.price").alias("buy_price"), F.col("sell.price").alias("sell_price"), ((F.col("sell.price") - F.col("buy.price")) * F.col("matched") - fees).alias("pnl"),
    )
