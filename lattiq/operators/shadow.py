"""A shadow of a trader: rules read from profitable round trips, what deviating from them cost, and which codes meet them today."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import asof
from .journal import hold_days

#: Features of a round trip, and those of its prices at the purchase (fixed values).
TRIP_FEATURES, PRICE_FEATURES = ("holding_days", "pnl_pct", "entry_hour", "entry_weekday"), ("entry_rsi14", "prior_5d_return")
#: Fewest trips behind a rule, most rules, holding range where there is no rule (fixed values).
LEAST_SUPPORT, MOST_RULES, NO_RULE = 3, 5, (1.0, 30.0)


def trip_features(trips: DataFrame, markets: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Profitable round trips with their features: days held, profit over cost, hour and weekday (0: Monday) of the purchase, market (from (symbol, market), else other), and, from a table (symbol, date, entry_rsi14,
    prior_5d_return), prices of the last bar up to the day of the purchase; bars after it are never seen."""
    t = hold_days(trips.where("pnl > 0")).join(markets.groupBy("symbol").agg(F.min("market").alias("market")), "symbol", "left")
    at = F.col("buy_at").cast("timestamp")
    t = t.select(
        *trips.columns, F.coalesce("market", F.lit("other")).alias("market"), F.col("hold_days").alias("holding_days"), F.try_divide("pnl", F.col("buy_price") * F.col("matched")).alias("pnl_pct"),
        F.hour(at).alias("entry_hour"), F.weekday(at).alias("entry_weekday"), F.to_date(at).alias("_day"),
    )
    if prices is None:
        return t.drop("_day").withColumns({c: F.lit(None).cast("double") for c in PRICE_FEATURES})
    return asof(t, prices, "symbol", "_day", "date", list(PRICE_FEATURES)).drop("_day")


def promoted(features: DataFrame, least: int = LEAST_SUPPORT) -> list[str]:
    """The features to cluster by: those of trips, and those of prices that at least so many trips have."""
    have = features.agg(*(F.count(c).alias(c) for c in PRICE_FEATURES)).first()  # one row of counts
    return [*TRIP_FEATURES, *(c for c in PRICE_FEATURES if have[c] >= least)]


def clusters(features: DataFrame, most: int = MOST_RULES, least: int = LEAST_SUPPORT, seed: int = 42) -> DataFrame:
    """features with `cluster`: k-means on scaled features (missing ones by their median, for grouping alone), with the k from 2 to `most` of the best silhouette. Three trips are needed, else all are cluster 0. A feature that no trip has is left out."""
    names = promoted(features, least)
    counts = features.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in names)).first()
    names = [c for c in names if counts[c]]
    if counts["_n"] <= 2 or most < 2 or not names:
        return features.withColumn("cluster", F.lit(0))
    raw, filled = [f"_x_{c}" for c in names], [f"_y_{c}" for c in names]
    p = features.withColumns({f"_x_{c}": F.col(c).cast("double") for c in names})
    p = Imputer(strategy="median", inputCols=raw, outputCols=filled).fit(p).transform(p)
    p = VectorAssembler(inputCols=filled, outputCol="_raw").transform(p)
    p = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(p).transform(p).persist()
    score = ClusteringEvaluator(featuresCol="_scaled", predictionCol="cluster")
    best, top = None, -2.0
    try:
        for k in range(2, min(most, counts["_n"] - 1) + 1):
            model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster").fit(p)
            if sum(size > 0 for size in model.summary.clusterSizes) < 2:
                continue
            got = score.evaluate(model.transform(p))
            if got > top:
                best, top = model, got
        if best is None:
            return features.withColumn("cluster", F.lit(0))
        return best.transform(p).drop(*raw, *filled, "_raw", "_scaled")
    finally:
        p.unpersist()


def rules(clustered: DataFrame, least: int = LEAST_SUPPORT, most: int = MOST_RULES) -> DataFrame:
    """rule (R1: most trips), market (commonest, ties by name), hours and days from the 10th to the 90th percentile as whole numbers (a day at least), the same of price features (two values needed), support, coverage.

    Clusters under `least` trips give no rule; of rules that agree in market and days the better supported stays. Where none is left, all trips make one rule. A percentile holds a cluster's distinct values, days and hours."""
    def found(df: DataFrame, by: list[str]) -> DataFrame:
        q = lambda c, p: F.bround(F.percentile(c, p)).cast("int")
        bounds = {f"{c}_{n}": F.when(F.count(c) >= 2, F.bround(F.percentile(c, p), 4)) for c in PRICE_FEATURES for n, p in (("low", 0.1), ("high", 0.9))}
        return df.groupBy(*by).agg(
            F.mode("market", True).alias("market"), q("entry_hour", 0.1).alias("hour_low"), q("entry_hour", 0.9).alias("hour_high"), F.greatest(F.lit(1), q("holding_days", 0.1)).alias("days_low"),
            q("holding_days", 0.9).alias("_high"), F.count(F.lit(1)).alias("support"), *(e.alias(n) for n, e in bounds.items()),
        ).withColumn("days_high", F.greatest("days_low", "_high")).drop("_high")

    total = clustered.agg(F.count(F.lit(1)).alias("_total"))
    dense = found(clustered, ["cluster"]).where(F.col("support") >= least)
    whole = found(clustered, []).withColumn("cluster", F.lit(-1)).where("support > 0")
    table = dense.withColumn("_first", F.lit(0)).unionByName(whole.withColumn("_first", F.lit(1)))
    # as many rows as clusters from here on
    table = table.withColumn("_kind", F.min("_first").over(W.partitionBy(F.lit(1)))).where("_first = _kind")
    best = W.partitionBy("market", "days_low", "days_high").orderBy(F.col("support").desc(), "cluster")
    table = table.withColumn("_same", F.row_number().over(best)).where("_same = 1").withColumn("_i", F.row_number().over(W.orderBy(F.col("support").desc(), "cluster"))).where(F.col("_i") <= most)
    out = table.crossJoin(F.broadcast(total))  # one row
    prices = [f"{c}_{n}" for c in PRICE_FEATURES for n in ("low", "high")]
    return out.select(F.concat(F.lit("R"), F.col("_i")).alias("rule"), "market", "hour_low", "hour_high", "days_low", "days_high", *prices, "support", F.round(F.col("support") / F.col("_total"), 3).alias("coverage"))


def holding_range(found: DataFrame) -> tuple[float, float]:
    """From the least to the greatest day of all rules."""
    r = found.agg(F.min("days_low").alias("low"), F.max("days_high").alias("high")).first()
    return NO_RULE if r["low"] is None else (float(r["low"]), float(r["high"]))


def impacts(trips: DataFrame, low: float, high: float) -> DataFrame:
    """Round trips with what a shadow would have earned more: `noise` (outside the days of the rules: the result itself, turned), `early` (gains sold before), `late` (losses held past), their sum `impact` and its reason."""
    t = hold_days(trips)
    pnl, hold, none = F.col("pnl"), F.col("hold_days"), F.lit(0.0)
    t = t.withColumns({
        "noise": F.when((hold < low) | (hold > high), -pnl).otherwise(none),
        "early": F.when((pnl > 0) & (hold < low), pnl * (low - hold) / max(low, 1.0)).otherwise(none),
        "late": F.when((pnl < 0) & (hold > high), -pnl * (hold - high) / max(high, 1.0)).otherwise(none),
    })
    reason = F.when((hold < low) | (hold > high), "rule_violation")
    return t.withColumn("impact", F.col("noise") + F.col("early") + F.col("late")).withColumn("reason", reason)


def overtrading_cost(trips: DataFrame, typical_days: float) -> DataFrame:
    """One row (overtrading): a trip every two typical holding times is expected from the first purchase to the last sale; of trips beyond, the ones with the smallest results are summed up and turned (of equal sizes losses first).

    Equal results are counted together first. A prefix over classes of size (a few thousand at most) and one within each class then order them, so no task sees all trips."""
    span = (F.unix_micros(F.max(F.col("sell_at").cast("timestamp"))) - F.unix_micros(F.min(F.col("buy_at").cast("timestamp")))) / 86_400_000_000
    if typical_days <= 0:
        return trips.agg(F.lit(0.0).alias("overtrading"))
    expected = F.greatest(F.lit(1.0), span / max(2.0 * typical_days, 1.0))
    extra = trips.agg(F.count(F.lit(1)).alias("_all"), expected.alias("_expected")).select(F.floor(F.greatest(F.col("_all") - F.col("_expected"), F.lit(0.0))).alias("_extra"))
    size = F.when(F.col("pnl") == 0, F.lit(-1_000_000)).otherwise(F.floor(F.log2(F.abs("pnl")) * 8))
    values = trips.where("pnl IS NOT NULL").groupBy("pnl").agg(F.count(F.lit(1)).alias("_n")).withColumn("_class", size)
    classes = values.groupBy("_class").agg(F.sum("_n").alias("_c")).withColumn("_base", F.sum("_c").over(W.orderBy("_class")) - F.col("_c"))
    inside = W.partitionBy("_class").orderBy(F.abs("pnl"), "pnl")
    v = values.withColumn("_upto", F.sum("_n").over(inside) - F.col("_n")).join(classes.select("_class", "_base"), "_class").crossJoin(F.broadcast(extra))  # one row
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_extra") - F.col("_base") - F.col("_upto")))
    return v.agg(F.coalesce(-F.sum(F.col("pnl") * taken), F.lit(0.0)).alias("overtrading"))


def attribution(trips: DataFrame, low: float, high: float, typical_days: float, shadow_pnl: float) -> DataFrame:
    """One row: real profit, the shadow's, and the difference by noise, early and late exits, overtrading; missed is what these leave unexplained."""
    s = impacts(trips, low, high).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in (("pnl", "real_pnl"), ("noise", "noise"), ("early", "early_exit"), ("late", "late_exit"))))
    s = s.crossJoin(F.broadcast(overtrading_cost(trips, typical_days))).withColumn("shadow_pnl", F.lit(float(shadow_pnl)))  # one row each
    return s.withColumn("missed", F.col("shadow_pnl") - F.col("real_pnl") - F.col("noise") - F.col("early_exit") - F.col("late_exit") - F.col("overtrading"))


def last_bar_features(panel: DataFrame, date: str = "date", code: str = "code", momentum: int = 5, mean: int = 20, volumes: int = 5) -> DataFrame:
    """code, bars, date, momentum, price_above_ma, volume_ratio (NULL without volume), entry_rsi14 (where the panel has `rsi`) of each code's last bar with a price; shorter histories take what they have. Codes need two bars and prices above 0."""
    back = W.partitionBy(code).orderBy(F.col(date).desc())
    p = panel.where(F.col("close").isNotNull()).withColumn("_i", F.row_number().over(back)).withColumn("_v", F.when(F.col("volume").isNotNull(), F.count("volume").over(back)))
    i, v = F.col("_i"), F.col("_v")
    rsi = F.max(F.when(i == 1, F.col("rsi"))) if "rsi" in panel.columns else F.lit(None).cast("double")
    last, prior = F.max(F.when(i == 1, F.col("close"))), F.max_by("close", F.when(i <= momentum + 1, i))
    newest, before = F.max(F.when(v == 1, F.col("volume"))), F.avg(F.when((v > 1) & (v <= volumes + 1), F.col("volume")))
    s = p.groupBy(code).agg(
        F.count(F.lit(1)).alias("bars"), F.max(date).alias(date), last.alias("_last"), F.when(prior != 0, last / prior - 1).alias("momentum"), (last > F.avg(F.when(i <= mean, F.col("close")))).alias("price_above_ma"),
        F.when((newest > 0) & (before > 0), newest / before).alias("volume_ratio"), rsi.alias("entry_rsi14"),
    )
    return s.where("bars >= 2 AND _last > 0 AND momentum IS NOT NULL").drop("_last")


def meets(condition: dict[str, tuple[float | None, float | None] | bool]) -> Column:
    """Whether a last bar is inside all bounds {feature: (low, high)} or has a flag's value; a missing feature isn't. Without conditions: it rises, is above its mean, and its volume, if known, grows."""
    if not condition:
        return (F.col("momentum") > 0) & F.col("price_above_ma") & F.coalesce(F.col("volume_ratio") > 1, F.lit(True))
    out = F.lit(True)
    for name, bound in condition.items():
        x = F.col(name)
        if isinstance(bound, bool):
            out = out & (x == bound)
            continue
        low, high = bound
        out = out & x.isNotNull() & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
    return F.coalesce(out, F.lit(False))


def scan(features: DataFrame, conditions: dict[str, tuple[str, dict]], market: str = "market", per_market: int = 3, code: str = "code") -> DataFrame:
    """(rule, market, code): of each rule {name: (market, condition)}, the first codes of its market whose last bar meets it. Rules are a handful of literals: a bar is looked at once per rule, no table is joined."""
    hits = F.filter(F.array(*(F.when((F.col(market) == m) & meets(c), F.lit(n)) for n, (m, c) in conditions.items())), lambda x: x.isNotNull())
    t = features.withColumn("rule", F.explode(hits))
    place = F.row_number().over(W.partitionBy("rule", market).orderBy(code))
    return t.select("rule", market, code, place.alias("_i")).where(F.col("_i") <= per_market).drop("_i")
