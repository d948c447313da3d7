"""Daily factors of minute bars (code, date, open, high, low, close, volume, amount and columns that order a day's bars), and of daily bars, as windows and grouped aggregates.

Prices and volumes of zero make no ratio: what divides by one is NULL, and so is the logarithm of one.
A day's windows and ranks are partitioned by code and date, so a shuffle by (code, date) serves them all; only `day_shapes` takes a day's volumes, and its bars by blocks, as groups. Too few bars in a day, or days in a window, give NULL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bars that a day needs at least: for ranks and shares, for volatility of volatility and jumps, for the volume profile (fixed values).
FEW, SOME, BUCKETS = 20, 30, 48
#: Share of a day's volume that counts as traded by the informed (fixed value).
SMART_SHARE = 0.2


def _full(x: Column, over, n: int, value: Column) -> Column:
    return F.when(F.count(x).over(over) == n, value)


def _when(rule: Column, x: Column) -> Column:
    return F.when(rule, x)


def _corr(x: Column, y: Column) -> Column:
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-13) & (sy > 1e-13), F.covar_pop(x, y) / (sx * sy)).otherwise(0.0)


def bars_of_day(minutes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """minutes with i and n (place and number of a day's bars), r (log return), dv (change of volume), pos (distance from the day's extremes so far), amp, and windows over them."""
    day = W.partitionBy("code", "date")
    w = day.orderBy(*order)
    five, so_far = w.rowsBetween(-4, 0), w.rowsBetween(W.unboundedPreceding, 0)
    c = F.col("close")
    m = minutes.withColumns({
        "i": F.row_number().over(w), "n": F.count(F.lit(1)).over(day), "r": F.ln(F.try_divide(c, F.lag(c).over(w))), "dv": F.col("volume") - F.lag("volume").over(w),
        "pos": 0.5 * (F.try_divide(c, F.min(c).over(so_far)) - 1) + 0.5 * (F.try_divide(F.max(c).over(so_far), c) - 1), "amp": F.try_divide(F.col("high") - F.col("low"), c), "ret5": F.try_divide(c, F.lag(c, 5).over(w)) - 1,
        "sum5": _full(F.col("volume"), five, 5, F.sum("volume").over(five)),
    })
    m = m.withColumns({"v5": _full(F.col("r"), five, 5, F.stddev_pop("r").over(five)), "sum5_before": F.lag("sum5").over(w), "dv_mean": F.avg("dv").over(day), "dv_sd": F.stddev_pop("dv").over(day), "s": F.when(F.col("volume") > 0, F.abs("r") / F.sqrt("volume"))})
    m = m.withColumn("ambiguity", _full(F.col("v5"), five, 5, F.stddev_pop("v5").over(five)))
    later = F.col("i") > 1
    by_s = day.orderBy(F.col("s").desc_nulls_last(), "i").rowsBetween(W.unboundedPreceding, 0)
    traded = F.when(F.col("s").isNotNull(), F.col("volume"))
    return m.withColumns({
        "ambiguity_mean": F.avg("ambiguity").over(day), "rank_r": F.when(later, F.row_number().over(day.orderBy(later.cast("int").desc(), F.col("r").asc_nulls_last(), "i"))),
        "rank_pos": F.when(later, F.row_number().over(day.orderBy(later.cast("int").desc(), F.col("pos").asc_nulls_last(), "i"))), "traded": traded, "cum_traded": F.sum(traded).over(by_s), "all_traded": F.sum(traded).over(day),
    })


def daily_factors(minutes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A row per code and date: ranks weighted by volume and range (game_*), volatility of volatility against turnover (cloud_*), asymmetry at surging and falling volume (treat_*), jump, rapids, smart_money, elasticity and
    entropy of the volume profile."""
    m = bars_of_day(minutes, order)
    n = F.max("n")
    weight = lambda rank, x: F.sum((2 * F.col(rank) - F.col("n")) * F.col(x))  # noqa: E731  n - 1 returns are ranked
    known, foggy = F.col("ambiguity").isNotNull(), F.col("ambiguity") > F.col("ambiguity_mean")
    share = lambda x: F.coalesce(F.try_divide(F.avg(_when(foggy, F.col(x))), F.avg(_when(known, F.col(x))) + 1e-10), F.lit(0.0))
    surge, plunge = F.col("dv") > F.col("dv_mean") + F.col("dv_sd"), F.col("dv") < F.col("dv_mean") - F.col("dv_sd")
    day_return = F.ln(F.try_divide(F.max(_when(F.col("i") == F.col("n"), F.col("close"))), F.max(_when(F.col("i") == 1, F.col("close")))))
    both = (F.count(_when(surge, F.lit(1))) >= 2) & (F.count(_when(plunge, F.lit(1))) >= 2)
    apart = lambda x: F.abs(F.avg(_when(surge, F.col(x))) - F.avg(_when(plunge, F.col(x))))
    simple = F.exp("r") - 1
    rapid = (F.col("sum5") > F.col("sum5_before")) & (F.col("ret5") < 0) & (F.col("i") >= 6) & (F.col("i") <= F.col("n") - 3)
    part = lambda x: F.try_divide(F.sum(_when(rapid, F.col(x))), F.sum(x))
    smart = F.col("cum_traded") - F.col("traded") < SMART_SHARE * F.col("all_traded")
    vwap = lambda rule: F.try_divide(F.sum(_when(rule, F.col("close") * F.col("traded"))), F.sum(_when(rule, F.col("traded"))))
    spike = F.coalesce(F.col("volume") > 2 * F.col("sum5") / 5, F.lit(False))
    calm = F.avg(_when(~spike, F.col("amp")))
    found = m.groupBy("code", "date").agg(
        F.when(n > FEW, weight("rank_r", "volume")).alias("game_ret"), F.when(n > FEW, weight("rank_pos", "volume")).alias("game_pos"), F.when(n > FEW, weight("rank_r", "amp")).alias("game_amp"),
        F.when((n >= SOME) & (F.count("ambiguity") >= 15), _corr(F.col("ambiguity"), F.when(known, F.col("amount")))).alias("cloud_corr"),
        F.when((n >= SOME) & (F.count("ambiguity") >= 15), share("amount")).alias("cloud_amount"), F.when((n >= SOME) & (F.count("ambiguity") >= 15), share("amount") - share("volume")).alias("cloud_spread"),
        F.when((n >= SOME) & (F.max("dv_sd") >= 1e-10), F.when(both, day_return * F.coalesce(apart("v5"), F.lit(0.0))).otherwise(0.0)).alias("treat_vol"),
        F.when((n >= SOME) & (F.max("dv_sd") >= 1e-10), F.when(both, day_return * apart("r")).otherwise(0.0)).alias("treat_ret"),
        F.when(n >= SOME, F.avg(2 * (simple - F.col("r")) - F.pow("r", F.lit(2)))).alias("jump"),
        F.when(n >= FEW, F.when(F.count(_when(rapid, F.lit(1))) >= 3, part("amount") - part("volume")).otherwise(0.0)).alias("rapids"),
        F.when((n >= FEW) & (F.count("s") >= 15), F.try_divide(vwap(smart), vwap(F.lit(True)))).alias("smart_money"),
        F.when((n >= FEW) & (calm >= 1e-10), 1 - F.coalesce(F.avg(_when(spike, F.col("amp"))), F.lit(0.0)) / calm).alias("elasticity"),
    )
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.try_divide(F.col("i") - 1, F.floor(F.col("n") / BUCKETS))))
    shares = m.where(F.col("n") >= BUCKETS).groupBy("code", "date", bucket.alias("b")).agg(F.sum("volume").alias("v"))
    total = F.sum("v").over(W.partitionBy("code", "date"))
    shares = shares.withColumn("p", F.col("v") / F.when(total > 0, total)).where("p > 0").groupBy("code", "date").agg(F.count(F.lit(1)).alias("k"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return found.join(shares.select("code", "date", F.when(F.col("k") >= 10, F.col("h")).alias("entropy")), ["code", "date"], "left")


def blend(daily: DataFrame, factor: str, window: int = 20, least: int = 5) -> DataFrame:
    """code, date, blended (half the sum of trailing mean and deviation), and distance (absolute z-score over the codes of a date)."""
    w = W.partitionBy("code").orderBy("date").rowsBetween(-(window - 1), 0)
    d = daily.select("code", "date", F.when(F.count(factor).over(w) >= least, (F.avg(factor).over(w) + F.stddev_samp(factor).over(w)) / 2).alias("blended"))
    at = W.partitionBy("date")
    sd = F.stddev_pop("blended").over(at)
    return d.withColumn("distance", F.when((F.count("blended").over(at) >= 5) & (sd >= 1e-10), F.abs((F.col("blended") - F.avg("blended").over(at)) / sd)))


def money_flow(minutes: DataFrame, order: tuple[str, ...], window: int = 20) -> DataFrame:
    """code, date, flow (sum of price change times volume, changes crossing days) and its trailing mean of 5 days at least."""
    w = W.partitionBy("code").orderBy("date", *order)
    d = minutes.withColumn("_f", (F.col("close") - F.lag("close").over(w)) * F.col("volume")).groupBy("code", "date").agg(F.sum("_f").alias("flow"))
    t = W.partitionBy("code").orderBy("date").rowsBetween(-(window - 1), 0)
    return d.withColumn("money_flow", F.when(F.count("flow").over(t) >= 5, F.avg("flow").over(t)))


def bar_factors(bars: DataFrame, window: int = 20, percentile: int = 60) -> DataFrame:
    """Daily-bar factors of brokers' reports: coin_team, overnight, divergence, amihud, downside, percentile, idio_vol (against the mean return of all codes) and reversal by equal and volume weights."""
    by = W.partitionBy("code").orderBy("date")
    t, long, prior = by.rowsBetween(-(window - 1), 0), by.rowsBetween(-(3 * window - 1), 0), by.rowsBetween(-window, -1)
    least = lambda x, over, k, value: F.when(F.count(x).over(over) >= k, value)
    mean = lambda x, over=t, k=5: least(x, over, k, F.avg(x).over(over))
    total = lambda x, over=t, k=5: least(x, over, k, F.sum(x).over(over))
    spread = lambda x, over=t, k=5: least(x, over, max(k, 2), F.stddev_samp(x).over(over))
    c, o = F.col("close"), F.col("open")
    before = F.lag(c).over(by)
    d = bars.withColumns({"inter": F.try_divide(c, before) - 1, "intra": F.try_divide(c, o) - 1, "night": F.try_divide(o, before) - 1, "logr": F.ln(F.try_divide(c, before))})
    d = d.withColumns({"turn": F.try_divide(F.col("volume"), mean("volume")), "market": F.avg("inter").over(W.partitionBy("date"))})
    d = d.withColumns({"turn_change": F.col("turn") - F.lag("turn").over(by), **{f"sd_{x}": spread(x) for x in ("inter", "intra", "night")}})
    flip = lambda x: F.when(F.col(x) < mean(x, long, window), -1).otherwise(1)
    coin = (total("inter") * (flip("sd_inter") + flip("turn_change")) / 2 + total("intra") * flip("sd_intra") + total("night") * flip("sd_night") * (1 + F.abs(F.col("night") - mean("night", long, window)))) / 3
    paired = F.when(F.col("inter").isNotNull() & F.col("market").isNotNull(), F.col("inter"))
    market = F.when(paired.isNotNull(), F.col("market"))
    var_m = F.var_pop(market).over(prior)
    beta = F.covar_pop(paired, market).over(prior) / F.when(var_m > 1e-18, var_m)
    resid = F.var_pop(paired).over(prior) + beta * beta * var_m - 2 * beta * F.covar_pop(paired, market).over(prior)
    below = F.size(F.filter(F.collect_list("close").over(by.rowsBetween(-(percentile - 1), 0)), lambda x: x < F.col("close")))
    seen = F.count("close").over(by.rowsBetween(-(percentile - 1), 0))
    sx, sy = F.stddev_samp("close").over(t), F.stddev_samp("volume").over(t)
    return d.select(
        "code", "date", coin.alias("coin_team"), mean("night", t, window).alias("overnight"),
        F.when((F.count("close").over(t) == window) & (sx > 1e-13) & (sy > 1e-13), F.covar_samp("close", "volume").over(t) / (sx * sy)).alias("divergence"),
        F.when(F.count("inter").over(t) == window, F.avg(F.abs("inter") / F.when(F.col("volume") > 0, F.col("volume"))).over(t)).alias("amihud"),
        F.when(F.count("inter").over(t) >= 10, F.sqrt(F.avg(F.when(F.col("inter").isNotNull(), F.pow(F.least(F.col("inter"), F.lit(0.0)), F.lit(2)))).over(t))).alias("downside"),
        F.when(seen >= 20, below / seen).alias("percentile"),
        F.when(F.count(paired).over(prior) == window, F.sqrt(F.greatest(resid, F.lit(0.0)))).alias("idio_vol"),
        F.when(F.count("logr").over(t) == window, F.avg("logr").over(t)).alias("reversal_equal"),
        F.when(F.count("logr").over(t) == window, F.try_divide(F.sum(F.col("logr") * F.col("volume")).over(t), F.sum(F.when(F.col("logr").isNotNull(), F.col("volume"))).over(t))).alias("reversal_volume"),
    )


#: Fewest bars of a spectrum, of followed peaks and of regressions; lags and bars of a regression, fewest regressions of a day; peaks looked at, bars between them and after them (fixed values).
FEW_SPECTRUM, LAGS, REGRESSED, FEW_FITS, PEAKS, APART = 12, 6, 30, 10, 10, 5
#: Bars of a block whose regressions are a group, and regressions solved at once (fixed values).
BLOCK, STACKED = 4096, 512


def followed_peaks(minutes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """code, date, follow: mean over a day's peaks of the volume of the next five bars in terms of the peak's. Of the ten bars of most volume (ties: earlier first) those count that come over five bars after the last that counts; NULL with under 30 bars or two peaks."""
    day = W.partitionBy("code", "date")
    w = day.orderBy(*order)
    v = F.col("volume")
    m = minutes.select("code", "date", "volume", F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(day).alias("n"), F.coalesce(F.sum("volume").over(w.rowsBetween(1, APART)), F.lit(0.0)).alias("_next"))
    m = m.withColumn("_place", F.row_number().over(day.orderBy(v.desc_nulls_last(), "i")))
    # ten peaks of a day at most
    top = F.array_sort(F.collect_list(F.when(F.col("_place") <= PEAKS, F.struct("i", F.when(v > 0, F.col("_next") / v).alias("f")))))
    s = m.groupBy("code", "date").agg(F.max("n").alias("n"), top.alias("_top"))
    start = F.struct(F.lit(-1000).alias("last"), F.lit(0).alias("peaks"), F.lit(0).alias("k"), F.lit(0.0).alias("s"))

    def step(a: Column, x: Column) -> Column:
        taken = x["i"] - a["last"] > APART
        known = x["f"].isNotNull()
        return F.when(taken, F.struct(x["i"].alias("last"), (a["peaks"] + 1).alias("peaks"), (a["k"] + known.cast("int")).alias("k"), (a["s"] + F.coalesce(x["f"], F.lit(0.0))).alias("s"))).otherwise(a)

    got = F.aggregate("_top", start, step)
    return s.withColumn("_g", got).select("code", "date", F.when((F.col("n") >= 30) & (F.col("_g.peaks") >= 2) & (F.col("_g.k") >= 2), F.col("_g.s") / F.col("_g.k")).alias("follow"))


def _spectrum(v: np.ndarray) -> float | None:
    v = v[~np.isnan(v)]
    if len(v) < FEW_SPECTRUM:
        return None
    low, high = np.percentile(v, [25, 75])
    v = np.clip(v, np.median(v) - 3 * (high - low), np.median(v) + 3 * (high - low))
    power = np.abs(np.fft.rfft((v - v.mean()) * np.hanning(len(v)))) ** 2
    whole = power[1:].sum()
    return float(power[max(1, round(0.4 * (len(power) - 1))) :].sum() / whole) if whole >= 1e-20 else None


def _lag_t(close: np.ndarray, volume: np.ndarray, start: int) -> np.ndarray:
    """t-values of the regressions that end at the bars from `start` on, a row each: the constant's and those of the lags. Rows with a missing number are zero in the stacked matrices, which leaves the fit as it is without them."""
    r, dv = np.diff(np.log(close)), np.diff(volume)
    ends = np.arange(start - 1, len(r))
    if not len(ends):
        return np.empty((0, LAGS + 1))
    lagged = np.lib.stride_tricks.sliding_window_view(dv, LAGS)[:, ::-1]  # a row per return, the latest change first
    place = ends[:, None] + np.arange(1 - REGRESSED, 1)
    x, y = lagged[place - (LAGS - 1)], r[place]
    good = np.isfinite(x).all(axis=2) & np.isfinite(y)
    n = good.sum(axis=1)
    x, y = np.where(good[:, :, None], x, 0.0), np.where(good, y, 0.0)
    first = x[:, :, 0]
    apart = np.where(good, first - (first.sum(axis=1) / np.maximum(n, 1))[:, None], 0.0)
    use = (n >= REGRESSED // 2) & (np.sqrt((apart**2).sum(axis=1) / np.maximum(n, 1)) >= 1e-15)
    x, y, n = np.concatenate([good[:, :, None].astype(float), x], axis=2)[use], y[use], n[use]
    u, s, v = np.linalg.svd(x, full_matrices=False)
    s2 = s * s + 1e-10
    # the fit of least length, and the diagonal of the inverse of x'x + 1e-10, each without the directions that are rounding noise
    known = s > np.finfo(float).eps * np.maximum(n, LAGS + 1)[:, None] * s[:, :1]
    fit = np.einsum("kji,kj->ki", v, np.where(known, np.einsum("kti,kt->ki", u, y) / np.where(known, s, 1.0), 0.0))
    spread = np.einsum("kji,kj->ki", v * v, np.where(s2 > 1e-15 * s2[:, :1], 1 / s2, 0.0))
    free = n - LAGS - 1
    left = ((y - np.einsum("kti,ki->kt", x, fit)) ** 2).sum(axis=1)
    left = np.where(left > (n * np.finfo(float).eps) ** 2 * (y**2).sum(axis=1), left, 0.0)  # an exact fit leaves rounding noise only
    error = np.sqrt(spread * np.where(free > 0, left / np.maximum(free, 1), 1.0)[:, None])
    return fit / np.where(error > 1e-15, error, 1.0)


def day_shapes(minutes: DataFrame, order: tuple[str, ...], size: int = BLOCK) -> DataFrame:
    """code, date, ripple: share of the volume's power in its faster waves; lag_spread, level_size, level: spread of the t-values of lagged volume changes in rolling regressions of returns, size and mean of the constant's.

    Regressions are taken in blocks of `size` bars of a day, at least the bars ahead of a regression, which bring the bars before them along, and added up; only the volumes of a day are a group of their own, for their spectrum."""
    kind = minutes.schema["code"].dataType.simpleString()
    keys = f"code {kind}, date date"
    before = LAGS + REGRESSED - 1  # bars ahead of the one at which a regression ends
    i = F.row_number().over(W.partitionBy("code", "date").orderBy(*order)) - 1
    m = minutes.select("code", "date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), i.alias("i"))
    block = F.floor(F.col("i") / size)
    carried = F.when(F.col("i") % size >= size - before, F.array(block, block + 1)).otherwise(F.array(block))

    def regressions(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i")
        # a day's first regressions end a bar later than its first full window
        start = max(size * int(p["b"].iloc[0]), before + 2) - int(p["i"].iloc[0])
        parts = [np.empty((0, LAGS + 1))]
        v, c = p["volume"].to_numpy(float), p["close"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in range(start, len(p), STACKED):
                stop = min(at + STACKED, len(p))
                parts.append(_lag_t(c[at - before : stop], v[at - before : stop], before))
        t = np.concatenate(parts)
        return pd.DataFrame([(p["code"].iloc[0], p["date"].iloc[0], None, len(t), t[:, 2:].std(axis=1).sum(), np.abs(t[:, 0]).sum(), t[:, 0].sum())], columns=["code", "date", "ripple", "k", "lag_spread", "level_size", "level"])

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["code"].iloc[0], pdf["date"].iloc[0], _spectrum(pdf.sort_values("i")["volume"].to_numpy(float)))], columns=["code", "date", "ripple"])

    fits = m.withColumn("b", F.explode(carried)).groupBy("code", "date", "b").applyInPandas(regressions, f"{keys}, ripple double, k long, lag_spread double, level_size double, level double")
    waves = m.select("code", "date", "volume", "i").groupBy("code", "date").applyInPandas(spectrum, f"{keys}, ripple double")
    found = fits.unionByName(waves, allowMissingColumns=True).groupBy("code", "date").agg(F.max("ripple").alias("ripple"), F.sum("k").alias("_k"), *(F.sum(c).alias(c) for c in ("lag_spread", "level_size", "level")))
    return found.select("code", "date", "ripple", *(F.when(F.col("_k") >= FEW_FITS, F.col(c) / F.col("_k")).alias(c) for c in ("lag_spread", "level_size", "level")))
