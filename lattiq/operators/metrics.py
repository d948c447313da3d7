"""Performance metrics of equity curves and trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def drawdowns(curve: DataFrame, at: str = "date", value: str = "equity", by: list[str] | None = None) -> DataFrame:
    """curve with peak so far and drawdown (0 or below)."""
    w = W.partitionBy(*(by or [])).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    return curve.withColumn("peak", F.max(value).over(w)).withColumn("drawdown", F.try_divide(F.col(value) - F.col("peak"), F.col("peak")))


def curve_metrics(curve: DataFrame, at: str = "date", value: str = "equity", by: list[str] | None = None, per_year: int = 252) -> DataFrame:
    """Per curve: total and annual return, volatility, Sharpe, Sortino (deviation of losing bars only), greatest drawdown, Calmar."""
    by = by or []
    w = W.partitionBy(*by).orderBy(at)
    c = drawdowns(curve, at, value, by).withColumn("_r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1)
    s = c.groupBy(*by).agg(
        F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"), F.count("_r").alias("n_bars"), F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"),
        F.stddev_samp(F.when(F.col("_r") < 0, F.col("_r"))).alias("_down"), F.min("drawdown").alias("max_drawdown"),
    )
    total = F.try_divide("_last", "_first") - 1
    annual = F.pow(1 + total, F.lit(float(per_year)) / F.greatest("n_bars", F.lit(1))) - 1
    root = float(per_year) ** 0.5
    return s.select(
        *by, "n_bars", total.alias("total_return"), annual.alias("annual_return"), (F.col("_std") * root).alias("volatility"), (F.col("_mean") / (F.col("_std") + 1e-10) * root).alias("sharpe"),
        (F.col("_mean") / (F.col("_down") + 1e-10) * root).alias("sortino"), "max_drawdown", F.try_divide(annual, F.abs("max_drawdown")).alias("calmar"),
    )


def trade_stats(trades: DataFrame, by: list[str] | None = None, at: str = "sell_at", pnl: str = "pnl", ties: tuple[str, ...] = ("sell_id", "buy_id")) -> DataFrame:
    """Per group: trades, win rate, average win over average loss, profit factor, longest run of losses. Runs are islands between wins in time order."""
    shown, by = by or [], by or ["_all"]
    trades = trades.withColumn("_all", F.lit(1))
    w = W.partitionBy(*by).orderBy(at, *ties).rowsBetween(W.unboundedPreceding, 0)
    t = trades.withColumn("_win", (F.col(pnl) > 0).cast("int")).withColumn("_island", F.sum("_win").over(w))
    runs = t.where(F.col(pnl) < 0).groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("_run")).groupBy(*by).agg(F.max("_run").alias("_longest"))
    win, loss = F.when(F.col(pnl) > 0, F.col(pnl)), F.when(F.col(pnl) < 0, -F.col(pnl))
    s = t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"), F.avg("_win").alias("win_rate"), F.sum(pnl).alias("total_pnl"), F.try_divide(F.avg(win), F.avg(loss)).alias("win_loss_ratio"), F.try_divide(F.sum(win), F.sum(loss)).alias("profit_factor"))
    return s.join(runs, by, "left").select(*shown, "n_trades", "win_rate", "total_pnl", "win_loss_ratio", "profit_factor", F.coalesce("_longest", F.lit(0)).alias("longest_losing_run"))
