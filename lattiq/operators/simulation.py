"""Backtests on panels: next-bar execution in windows where no state is needed, and a grouped map per run where positions, cash and lots depend on what came before."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def align_signals(panel: DataFrame, signal: str, fill: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """panel with weight: the signal of the bar before (carried over at most `fill` missing bars, clipped to [-1, 1]), scaled down where a date's absolute weights exceed 1."""
    ordered = W.partitionBy(code).orderBy(date)
    clipped = F.when(F.col(signal).isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(signal))))
    held = F.last(clipped, ignorenulls=True).over(ordered.rowsBetween(-fill, 0))
    p = panel.withColumn("_held", held).withColumn("_raw", F.coalesce(F.lag("_held").over(ordered), F.lit(0.0)))
    gross = F.sum(F.abs("_raw")).over(W.partitionBy(date))
    return p.withColumn("weight", F.col("_raw") / F.greatest(gross, F.lit(1.0))).drop("_held", "_raw")


def portfolio_returns(aligned: DataFrame, cost: float = 0.001, code: str = "code", date: str = "date") -> DataFrame:
    """date, ret, turnover: return from this open to the code's next, by weight, less the cost of weights changed."""
    ordered = W.partitionBy(code).orderBy(date)
    p = aligned.withColumn("_next", F.try_divide(F.lead("open").over(ordered), F.col("open")) - 1).withColumn("_moved", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(ordered), F.lit(0.0))))
    return p.groupBy(date).agg((F.sum(F.col("weight") * F.coalesce("_next", F.lit(0.0))) - cost * F.sum("_moved")).alias("ret"), F.sum("_moved").alias("turnover"))


#: Rules by market (fixed values): lot size, fee rate and least fee, transfer fee, tax on sales, slippage, shorts allowed, days before a purchase may be sold, price limit of a bar.
NO_RULES = {"lot": 0, "fee": 0.0, "least_fee": 0.0, "transfer": 0.0, "tax": 0.0, "slip": 0.0, "short": True, "wait": 0, "limit": None}
MARKETS = {
    "china_a": NO_RULES | {"lot": 100, "fee": 0.00025, "least_fee": 5.0, "transfer": 0.00001, "tax": 0.0005, "slip": 0.001, "short": False, "wait": 1, "limit": 0.1},
    "us_equity": NO_RULES | {"lot": 1},
    "crypto": NO_RULES | {"fee": 0.001},
    "forex": NO_RULES | {"lot": 1000, "fee": 0.00002},
}


def trade_fee(rules: dict, amount: float, sale: bool) -> float:
    """What a trade of that amount costs: the fee, but not less than the least one, transfer fee and, for sales, tax."""
    return max(amount * rules["fee"], rules["least_fee"]) + amount * (rules["transfer"] + (rules["tax"] if sale else 0.0))


def simulate(aligned: DataFrame, market: str = "us_equity", cash: float = 1_000_000.0, run_col: str = "run", code: str = "code", date: str = "date") -> DataFrame:
    """run, date, cash, equity, trades of a bar-by-bar simulation: at each open, positions move to their target weight of equity, in lots, by the market's rules; codes take turns in sorted order and share cash. Where a price limit holds, nothing is
    bought at an open that is up by the limit on the last close, and nothing sold at one that is down by it.

    Runs (parameter sets, universes) are independent and spread over the cluster; inside a run the bars depend on each other, so a run is one group.
    """
    rules = MARKETS[market]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([date, code], kind="stable")
        held: dict[str, float] = {}
        bought: dict[str, int] = {}
        last: dict[str, float] = {}
        free, out = cash, []
        for day, (when, bar) in enumerate(pdf.groupby(date, sort=True)):
            change = {c: o / last[c] - 1 for c, o in zip(bar[code], bar["open"], strict=True) if last.get(c, 0.0) > 0 and o == o and o > 0}
            for c, o in zip(bar[code], bar["open"], strict=True):
                if o == o and o > 0:
                    last[c] = o
            equity = free + sum(q * last.get(c, 0.0) for c, q in held.items())
            n = 0
            for c, o, w in zip(bar[code], bar["open"], bar["weight"], strict=True):
                if not (o == o and o > 0):
                    continue
                target = equity * (w if rules["short"] else max(w, 0.0)) / o
                if not math.isfinite(target):
                    continue
                if rules["lot"]:
                    target = int(target / rules["lot"]) * rules["lot"]
                move = target - held.get(c, 0.0)
                if abs(move) * o < 1e-9 or (move < 0 and rules["wait"] and bought.get(c, -9) > day - 1 - rules["wait"] + 1):
                    continue
                if rules["limit"] and (change.get(c, 0.0) >= rules["limit"] - 0.001 if move > 0 else change.get(c, 0.0) <= 0.001 - rules["limit"]):
                    continue
                at = o * (1 + (rules["slip"] if move > 0 else -rules["slip"]))
                fee = trade_fee(rules, abs(move) * at, move < 0)
                if move > 0 and move * at + fee > free:
                    move = max(0.0, (free - rules["least_fee"]) / (at * (1 + rules["fee"] + rules["transfer"])))
                    move = int(move / rules["lot"]) * rules["lot"] if rules["lot"] else move
                    fee = trade_fee(rules, move * at, False)
                    if move <= 0:
                        continue
                free -= move * at + fee
                held[c] = held.get(c, 0.0) + move
                if move > 0:
                    bought[c] = day
                n += 1
            for c, x in zip(bar[code], bar["close"], strict=True):
                if x == x:
                    last[c] = x
            out.append((pdf[run_col].iloc[0], when, free, free + sum(q * last.get(c, 0.0) for c, q in held.items()), n))
        return pd.DataFrame(out, columns=[run_col, date, "cash", "equity", "trades"])

    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema}
    return aligned.select(run_col, date, code, "open", "close", "weight").groupBy(run_col).applyInPandas(run, f"{run_col} {kinds[run_col]}, {date} {kinds[date]}, cash double, equity double, trades long")
