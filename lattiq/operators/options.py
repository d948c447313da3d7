"""Option prices and sensitivities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, by a rational approximation (absolute error below 1e-7): Spark has no error function."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(x))
    tail = normal_pdf(x) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_scholes(df: DataFrame, spot: str, strike: str, years: str, rate: float, vol: str, call: str) -> DataFrame:
    """df with price, delta, gamma, theta (a day) and vega (a point of volatility); at expiry or without volatility the inner value and its slope.

    Shared terms become columns of their own, layer by layer, so that generated code stays small.
    """
    S, K, T, V = (F.col(c) for c in (spot, strike, years, vol))
    live = (T > 0) & (V > 0) & (S > 0) & (K > 0)
    d = df.withColumns({"_sign": F.when(F.col(call), 1.0).otherwise(-1.0), "_root": F.when(live, V * F.sqrt(T)), "_disc": K * F.exp(-rate * T)})
    d = d.withColumn("_d1", (F.log(S / K) + (rate + V * V / 2) * T) / F.col("_root"))
    d = d.withColumns({"_n1": normal_cdf(F.col("_sign") * F.col("_d1")), "_pdf": normal_pdf(F.col("_d1")), "_x2": F.col("_sign") * (F.col("_d1") - F.col("_root"))})
    d = d.withColumn("_n2", normal_cdf(F.col("_x2"))).withColumn("_inner", F.greatest(F.lit(0.0), F.col("_sign") * (S - K)))
    on, sign = F.col("_root").isNotNull(), F.col("_sign")
    theta = (-S * F.col("_pdf") * V / (2 * F.sqrt(T)) - sign * rate * F.col("_disc") * F.col("_n2")) / 365
    out = {
        "price": F.when(on, sign * (S * F.col("_n1") - F.col("_disc") * F.col("_n2"))).otherwise(F.col("_inner")), "delta": F.when(on, sign * F.col("_n1")).otherwise(F.when(F.col("_inner") > 0, sign).otherwise(F.lit(0.0))),
        "gamma": F.when(on, F.col("_pdf") / (S * F.col("_root"))).otherwise(F.lit(0.0)), "theta": F.when(on, theta).otherwise(F.lit(0.0)), "vega": F.when(on, S * F.col("_pdf") * F.sqrt(T) / 100).otherwise(F.lit(0.0)),
    }
    return d.select(*df.columns, *(c.alias(n) for n, c in out.items()))


def smile(spot: Column, strike: Column, base: Column, skew: float = -0.15, curvature: float = 0.05) -> Column:
    """Volatility over the log of strike to spot: a quadratic smile, at least 0.01."""
    k = F.log(strike / spot)
    return F.greatest(F.lit(0.01), base + skew * k + curvature * k * k)
