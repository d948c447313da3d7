"""States of a market and crowding of factors: a level of mean returns by date, and windows over it. Codes are summed up by date first; windows run over dates alone, a row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Windows and bounds of the signals (fixed values).
CRISIS_BARS, CRISIS_DROP, CRISIS_Z, BEAR_BARS, BEAR_DROP = 250, -0.10, 2.0, 120, -0.10
YEARS, SHARE_BARS, LEAST, EXTREME = 5 * 252, 1250, 250, 1.5


def _roll(x: Column, how: str, n: int, order: str, least: int | None = None) -> Column:
    """An aggregate of the last n values, NULL with fewer than `least` (all n by default)."""
    w = W.orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) >= (n if least is None else least), getattr(F, how)(x).over(w))


def _past(x: Column, order: str) -> Column:
    return F.lag(x).over(W.orderBy(order))


def market_level(panel: DataFrame, price: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """date, ret, level: mean return of the codes with a bar (0 for a first bar) and its running product."""
    x = F.col(price)
    own = F.coalesce(F.try_divide(x, F.lag(x).over(W.partitionBy(code).orderBy(date))) - 1, F.lit(0.0))
    by_date = panel.select(date, own.alias("_r")).groupBy(date).agg(F.avg("_r").alias("ret"))
    return by_date.withColumn("level", F.exp(F.sum(F.log1p("ret")).over(W.orderBy(date))))


def states(levels: DataFrame, date: str = "date") -> DataFrame:
    """levels with the signals known at a date's end: `bear` (below the 250-bar mean of 20 bars at least, or 15 % below the peak), `bear_fast` (40 bars, 10 %, a day's, three days' or twenty days' fall), `crisis` (10 % below the 250-bar mean, or
    volatility two deviations up) with `stress` from 0 to 1, `bear_vote` (any of four slower signs) and `label` bull, bear or osc. What can't be told yet is false."""
    x, r = F.col("level"), F.col("_r")
    p = levels.withColumn("_r", F.try_divide(x, _past(x, date)) - 1).withColumn("_vol", _roll(r, "stddev_samp", 20, date))
    drop = x / F.max(x).over(W.orderBy(date)) - 1
    to_mean = lambda n, least=None: F.try_divide(x, _roll(x, "avg", n, date, least)) - 1
    to_top = lambda n, least=None: F.try_divide(x, _roll(x, "max", n, date, least)) - 1
    any_of = lambda *rules: F.greatest(*(F.coalesce(k, F.lit(False)) for k in rules))
    day = F.coalesce(r, F.lit(0.0))
    vol = F.col("_vol")
    z = (vol - _roll(vol, "avg", 250, date)) / (_roll(vol, "stddev_samp", 250, date) + 1e-9)
    deep, slow = to_mean(CRISIS_BARS), to_mean(BEAR_BARS)
    low20 = _roll(x, "min", 20, date)
    bear = F.coalesce(slow < BEAR_DROP, F.lit(False))
    calm = any_of(F.abs(x - _roll(x, "avg", BEAR_BARS, date)) / (_roll(x, "avg", BEAR_BARS, date) + 1e-9) < 0.07, (_roll(x, "max", 20, date) - low20) / (low20 + 1e-9) < 0.12)
    return p.select(
        *levels.columns,
        any_of(to_mean(250, 20) < 0, drop < -0.15).alias("bear"),
        any_of(to_mean(40, 10) < 0, drop < -0.10, day < -0.05, _roll(day, "sum", 3, date) < -0.08, to_top(20, 5) < -0.10).alias("bear_fast"),
        any_of(deep < CRISIS_DROP, z > CRISIS_Z).alias("crisis"),
        F.when(deep < -0.10, 1.0).when(deep < 0, -deep / 0.10).otherwise(0.0).alias("stress"),
        any_of(slow < BEAR_DROP, to_mean(60) < -0.08, to_top(20) < -0.12, vol > 2.5 * F.nullif(_roll(vol, "avg", 250, date), F.lit(0.0))).alias("bear_vote"),
        F.when(bear, "bear").when(calm, "osc").otherwise("bull").alias("label"),
    )


def share_at_least(df: DataFrame, name: str, n: int = 1260, least: int = LEAST, date: str = "date") -> Column:
    """Share of the last n values that are no smaller than the current one. The window's values are an array, so n bounds a row's memory."""
    w = W.orderBy(date).rowsBetween(1 - n, 0)
    x = F.col(name)
    held = F.collect_list(x).over(w)
    return F.when(x.isNotNull() & (F.size(held) >= least), F.size(F.filter(held, lambda v: v >= x)) / F.size(held))


def market_environment(panel: DataFrame, ret: str = "ret_20", means: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """date, mean, deviation and share of risers of `ret`, means of further columns, and extreme: 1 where that mean is 1.5 deviations above its five years."""
    env = panel.groupBy(date).agg(F.avg(ret).alias("env_mean"), F.stddev_samp(ret).alias("env_std"), F.avg((F.coalesce(F.col(ret) > 0, F.lit(False))).cast("double")).alias("env_rising"), *(F.avg(c).alias(f"env_{c}") for c in means))
    m = F.col("env_mean")
    z = (m - _roll(m, "avg", YEARS, date, LEAST)) / (_roll(m, "stddev_samp", YEARS, date, LEAST) + 1e-8)
    return env.withColumn("extreme", F.coalesce((z > EXTREME).cast("double"), F.lit(0.0)))


def crowding(panel: DataFrame, factor: str, amount: str = "amount", ret: str = "ret", date: str = "date") -> DataFrame:
    """date, crowding: turnover and volatility of the top tenth by the factor over those of the bottom tenth, each over 120 dates, their mean as a deviation from five years of it."""
    x = F.col(factor)
    by_value = W.partitionBy(date, factor)
    some = panel.where(x.isNotNull())
    place = (F.rank().over(W.partitionBy(date).orderBy(x)) + (F.count(F.lit(1)).over(by_value) - 1) / 2) / F.count(F.lit(1)).over(W.partitionBy(date))
    legs = some.withColumn("_p", place).groupBy(date).agg(
        *(F.avg(F.when(rule, F.col(c))).alias(n) for n, rule, c in (("_la", F.col("_p") >= 0.9 - 1e-9, amount), ("_sa", F.col("_p") <= 0.1 + 1e-9, amount), ("_lr", F.col("_p") >= 0.9 - 1e-9, ret), ("_sr", F.col("_p") <= 0.1 + 1e-9, ret)))
    )
    roll = lambda c, how: _roll(F.col(c), how, 120, date, 60)
    raw = legs.select(date, ((roll("_la", "avg") / (roll("_sa", "avg") + 1e-8) + roll("_lr", "stddev_samp") / (roll("_sr", "stddev_samp") + 1e-8)) / 2).alias("_raw"))
    r = F.col("_raw")
    return raw.select(date, ((r - _roll(r, "avg", YEARS, date, LEAST)) / (_roll(r, "stddev_samp", YEARS, date, LEAST) + 1e-8)).alias("crowding"))


def crowding_features(levels: DataFrame, name: str = "crowding", extreme: str = "extreme", date: str = "date") -> DataFrame:
    """levels with share_below (of 1250 dates), roc (over 5), both times the extreme flag, and a penalty above the 95th percentile."""
    s, e = F.col(name), F.coalesce(F.col(extreme), F.lit(0.0))
    held = F.collect_list(s).over(W.orderBy(date).rowsBetween(1 - SHARE_BARS, 0))
    p = levels.withColumn("_all", held).withColumn("share_below", F.when(s.isNotNull() & (F.size("_all") >= LEAST), F.size(F.filter("_all", lambda v: v < s)) / F.size("_all"))).drop("_all")
    roc = (s - F.lag(s, 5).over(W.orderBy(date))) / (F.abs(s) + 1e-8)
    p = p.withColumn("roc", roc)
    return p.withColumns({"level_x_extreme": s * e, "roc_x_extreme": F.col("roc") * e, "penalty": F.when(F.col("share_below") > 0.95, (F.col("share_below") - 0.95) * -10).otherwise(0.0)})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, accuracy: int = 1_000_000) -> DataFrame:
    """Columns clipped to their quantiles over all rows, from a mergeable sketch of bounded size (rank error 1 / accuracy); one aggregate for all columns, its one row joined back."""
    bounds = df.agg(*(F.percentile_approx(c, [low, high], accuracy).alias(f"_q_{c}") for c in columns))
    out = df.crossJoin(F.broadcast(bounds))  # one row
    return out.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_q_{c}")[0]), F.col(f"_q_{c}")[1])) for c in columns}).drop(*bounds.columns)


def interactions(panel: DataFrame, by_date: DataFrame, left: list[str], right: list[str], date: str = "date") -> DataFrame:
    """panel with ix_<right>__<left> products of its columns and those of a table of dates."""
    out = panel.join(by_date.select(date, *right), date, "left")
    return out.withColumns({f"ix_{r}__{x}": F.col(r) * F.col(x) for r in right for x in left})


#: Named states, the first that fits counts: mean of 60 over that of 250, price over mean of 60, ranges (both ends in) of the last 20 and 5 bars' return and of the distance from the mean of 250 (percent), of yearly volatility, and of bars in a row with MACD at 0 or above (fixed values).
NAMED = (
    ("strong_bull", {"above": True, "over": True, "ret20": (3.0, 100.0), "macd_run": (15, 999)}),
    ("strong_bear", {"above": False, "over": False, "ret20": (-100.0, -3.0), "macd_run": (15, 999)}),
    ("pullback", {"above": True, "over": False, "ret5": (-100.0, 0.0)}),
    ("bounce", {"above": False, "over": True, "ret5": (0.0, 100.0)}),
    ("grind_up", {"above": True, "over": True, "ret20": (0.0, 3.0)}),
    ("grind_down", {"above": False, "over": False, "ret20": (-3.0, 0.0)}),
    ("wide_range", {"distance": (-5.0, 5.0), "vol20": (20.0, 999.0)}),
    ("tight_range", {"distance": (-3.0, 3.0), "vol20": (0.0, 15.0)}),
)


def state_features(bars: DataFrame, price: str = "close", code: str = "code", date: str = "date") -> DataFrame:
    """code, date, price with above, over, over_before (5 bars ago), ret5, ret20, vol20, distance, macd_run (below 0: negative) of each bar. A comparison with what isn't known yet is false, a return or volatility that isn't is 0."""
    from ..functions import expr as X
    from ..functions.expr import Compiler

    c = X.col(price)
    macd = X.sma(c, 13, 2) - X.sma(c, 27, 2)  # exponential means over 12 and 26 bars
    p = Compiler({"_macd": macd}, code=code, date=date).apply(bars.where(F.col(price).isNotNull()), keep=(price,))
    own = W.partitionBy(code).orderBy(date)
    x = F.col(price)
    mean = lambda n, least: F.when(F.count(x).over(own.rowsBetween(1 - n, 0)) >= least, F.avg(x).over(own.rowsBetween(1 - n, 0)))
    past = lambda d: F.coalesce((F.try_divide(x, F.lag(x, d).over(own)) - 1) * 100, F.lit(0.0))
    p = p.withColumns({"_m60": mean(60, 20), "_m250": mean(250, 60), "ret5": past(5), "ret20": past(20), "_r": F.try_divide(x, F.lag(x).over(own)) - 1, "_up": F.coalesce(F.col("_macd") >= 0, F.lit(False))})
    w20 = own.rowsBetween(-19, 0)
    known = lambda rule: F.coalesce(rule, F.lit(False))
    p = p.withColumns({
        "above": known(F.col("_m60") >= F.col("_m250")), "over": known(x >= F.col("_m60")), "vol20": F.coalesce(F.when(F.count("_r").over(w20) >= 20, F.stddev_samp("_r").over(w20)), F.lit(0.0)) * 252**0.5 * 100,
        "distance": (x - F.col("_m250")) / F.when(F.col("_m250") == 0, 1.0).otherwise(F.col("_m250")) * 100, "_turn": (F.col("_up") != F.coalesce(F.lag("_up").over(own), ~F.col("_up"))).cast("int"),
    })
    p = p.withColumns({"_run": F.sum("_turn").over(own.rowsBetween(W.unboundedPreceding, 0)), "over_before": F.coalesce(F.lag("over", 5).over(own), F.lit(False))})
    place = F.row_number().over(W.partitionBy(code, "_run").orderBy(date))
    return p.select(code, date, price, "above", "over", "over_before", "ret5", "ret20", "vol20", "distance", F.when(F.col("_up"), place).otherwise(-place).alias("macd_run"))


def named_states(features: DataFrame, least: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """features with `state` (tight_range where none fits), `state_now` (a pullback must come from above the mean five bars ago, a bounce from below it, else the next that fits) and `settled`: the state of the last run of at least `least` bars that began by then, NULL before one."""
    def fits(rule: dict) -> Column:
        out = F.lit(True)
        for name, want in rule.items():
            x = F.col(name)
            out = out & ((x == want) if isinstance(want, bool) else (x >= want[0]) & (x <= want[1]))
        return F.coalesce(out, F.lit(False))

    state, now = F, F
    before = {"pullback": F.col("over_before"), "bounce": ~F.col("over_before")}
    for name, rule in NAMED:
        state, now = state.when(fits(rule), name), now.when(fits(rule) & before.get(name, F.lit(True)), name)
    own = W.partitionBy(code).orderBy(date)
    p = features.withColumns({"state": state.otherwise("tight_range"), "state_now": now.otherwise("tight_range")})
    p = p.withColumn("_turn", (~F.col("state").eqNullSafe(F.lag("state").over(own))).cast("int")).withColumn("_run", F.sum("_turn").over(own.rowsBetween(W.unboundedPreceding, 0)))
    p = p.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(code, "_run")))
    settled = F.last(F.when(F.col("_n") >= least, F.col("state")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    return p.withColumn("settled", settled).drop("_turn", "_run", "_n")
