"""Registered queries of chart patterns, market states, crowding, weights, market rules and signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.expr import NUDGE
from .operators import charts, market_rules, optimizers, regimes, signals
from .plans import chips
from .plans.panel import BRAND_PANEL_SQL, brand_panel, table
from .queries import _r, _sqlr, query


def _points_sql(window: int, high: str = "close", low: str = "close") -> str:
    return f"""turn AS (SELECT code, date, {high} AS h, {low} AS l, max({high}) OVER a AS top, min({low}) OVER a AS bottom, count(*) OVER a AS n FROM panel
    WINDOW a AS (PARTITION BY code ORDER BY date ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING)),
points AS (SELECT code, date, 'H' AS kind, h AS price FROM turn WHERE n = {2 * window + 1} AND h = top UNION ALL SELECT code, date, 'L', l FROM turn WHERE n = {2 * window + 1} AND l = bottom)"""


_ZIG_SQL = f"""WITH {BRAND_PANEL_SQL}, {_points_sql(2, 'high', 'low')},
single AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY code, date) AS same FROM points) WHERE same = 1),
islands AS (SELECT *, sum(turned) OVER (PARTITION BY code ORDER BY date, kind ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY code ORDER BY date, kind) THEN 0 ELSE 1 END AS turned FROM single)),
zig AS (SELECT code, date, kind, price FROM islands QUALIFY row_number() OVER (PARTITION BY code, island ORDER BY CASE WHEN kind = 'H' THEN price ELSE -price END DESC, date) = 1),
q AS (SELECT code, date, CASE WHEN kind = 'L' THEN 1 ELSE -1 END AS s, {', '.join(f"CASE WHEN kind = 'L' THEN 1 ELSE -1 END * lead(price, {i}) OVER w AS q{i}, lead(date, {i}) OVER w AS d{i}" for i in range(6))}
  FROM zig WINDOW w AS (PARTITION BY code ORDER BY date, kind))"""


def _zig(spark, sf_dir):
    return charts.zigzag(charts.turning_points(brand_panel(spark, sf_dir), 2, "high", "low"))


@query(f"WITH {BRAND_PANEL_SQL}, {_points_sql(10)} SELECT code, date, kind, {_sqlr('price', digits=4)} FROM points")
def chart_turning_points(spark, sf_dir):
    return charts.turning_points(brand_panel(spark, sf_dir)).select("code", "date", "kind", _r("price", 4))


@query(f"""WITH {BRAND_PANEL_SQL}, {_points_sql(3)}, p AS (SELECT *, lag(price) OVER w AS a, lead(price) OVER w AS b FROM points WHERE kind = 'H' WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT code, date, {_sqlr('price', digits=4)} FROM p WHERE price > a AND price > b AND abs(a - b) / ((a + b) / 2) <= 0.05""")
def chart_head_and_shoulders(spark, sf_dir):
    return charts.head_and_shoulders(charts.turning_points(brand_panel(spark, sf_dir), 3)).select("code", "date", _r("price", 4))


@query(f"""WITH {BRAND_PANEL_SQL}, {_points_sql(3)}, p AS (SELECT *, lag(price) OVER (PARTITION BY code, kind ORDER BY date) AS a FROM points)
SELECT code, date, max(CASE WHEN kind = 'H' THEN 1 ELSE -1 END) AS twin FROM p WHERE abs(price - a) / ((price + a) / 2) < 0.03 GROUP BY code, date""")
def chart_double_points(spark, sf_dir):
    return charts.double_points(charts.turning_points(brand_panel(spark, sf_dir), 3))


@query(f"""WITH {BRAND_PANEL_SQL},
t AS (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS i, CASE WHEN count(*) OVER a = 9 AND close = max(close) OVER a THEN close END AS h, CASE WHEN count(*) OVER a = 9 AND close = min(close) OVER a THEN close END AS l
  FROM panel WINDOW a AS (PARTITION BY code ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
b AS (SELECT x.code, x.i, list(y.h ORDER BY y.i) FILTER (y.h IS NOT NULL) AS hs, list(y.l ORDER BY y.i) FILTER (y.l IS NOT NULL) AS ls FROM t x JOIN t y ON x.code = y.code AND y.i BETWEEN x.i - 16 AND x.i - 4 WHERE x.i > 20 GROUP BY x.code, x.i),
v AS (SELECT *, list_max(hs) - list_min(ls) AS spread, (SELECT regr_slope(e, k) FROM (SELECT unnest(hs) AS e, unnest(range(len(hs))) AS k)) AS ps, (SELECT regr_slope(e, k) FROM (SELECT unnest(ls) AS e, unnest(range(len(ls))) AS k)) AS vs FROM b WHERE len(hs) >= 2 AND len(ls) >= 2)
SELECT t.code, t.date, CASE WHEN spread <> 0 AND vs > spread * 0.02 AND abs(ps) < spread * 0.02 THEN 1 WHEN spread <> 0 AND ps < -spread * 0.02 AND abs(vs) < spread * 0.02 THEN -1 ELSE 0 END AS triangle,
  CASE WHEN len(list_filter(range(1, len(hs)), lambda j: hs[j + 1] <= hs[j])) = 0 AND len(list_filter(range(1, len(ls)), lambda j: ls[j + 1] >= ls[j])) = 0 THEN 1 ELSE 0 END AS broadening
FROM t LEFT JOIN v USING (code, i) WHERE i > 20""")
def chart_converging(spark, sf_dir):
    return charts.converging(brand_panel(spark, sf_dir))


def _between(x: str, bounds, tolerance: float) -> str:
    return f"{x} >= {bounds[0]} - {tolerance} AND {x} <= {bounds[1]} + {tolerance}"


_W = {"w1": "(q1 - q0)", "w2": "(q1 - q2)", "w3": "(q3 - q2)", "w4": "(q3 - q4)", "w5": "(q5 - q4)"}


@query(f"""{_ZIG_SQL}
SELECT code, d5 AS date, 'impulse' AS wave, -s AS signal FROM q WHERE q5 IS NOT NULL AND {_W['w1']} > 0 AND {_W['w3']} > 0 AND {_W['w5']} > 0 AND q2 > q0 AND NOT ({_W['w3']} < {_W['w1']} AND {_W['w3']} < {_W['w5']}) AND q4 > q1
  AND least(d1 - d0, d2 - d1, d3 - d2, d4 - d3, d5 - d4) >= 1 AND {_between(f"{_W['w2']} / {_W['w1']}", (0.5, 0.618), 0.15)} AND {_between(f"{_W['w3']} / {_W['w1']}", (1.0, 2.618), 0.15)} AND {_between(f"{_W['w4']} / {_W['w3']}", (0.236, 0.5), 0.15)}
UNION ALL SELECT code, d3, 'abc', -s FROM q WHERE q3 IS NOT NULL AND {_W['w1']} > 0 AND {_W['w2']} > 0 AND {_W['w3']} > 0 AND q2 > q0 AND least(d1 - d0, d2 - d1, d3 - d2) >= 1
  AND {_between(f"{_W['w2']} / {_W['w1']}", (0.382, 0.618), 0.15)} AND {_between(f"{_W['w3']} / {_W['w1']}", (0.618, 1.618), 0.15)}""")
def chart_waves(spark, sf_dir):
    return charts.waves(_zig(spark, sf_dir), least_days=1)


_SHAPES = " ".join(f"WHEN {_between('ab / xa', b, 0.08)} AND {_between('ad / xa', d, 0.08)} THEN '{n}'" for n, (b, d) in charts.HARMONIC.items())


@query(f"""{_ZIG_SQL}, x AS (SELECT *, abs(q1 - q0) AS xa, abs(q2 - q1) AS ab, abs(q3 - q2) AS bc, abs(q4 - q1) AS ad FROM q WHERE q4 IS NOT NULL), y AS (SELECT code, d4 AS date, CASE {_SHAPES} END AS shape, s AS direction, q4 * s AS price FROM x WHERE xa > 0 AND ab > 0 AND bc > 0)
SELECT code, date, shape, direction, {_sqlr('price', digits=4)} FROM y WHERE shape IS NOT NULL""")
def chart_harmonics(spark, sf_dir):
    return charts.harmonics(_zig(spark, sf_dir)).select("code", "date", "shape", "direction", _r("price", 4))


@query()
def chart_price_levels(spark, sf_dir):
    return charts.price_levels(charts.turning_points(brand_panel(spark, sf_dir), 10)).select("code", "kind", _r("level", 4), "points")


# ---------------------------------------------------------------------------------------------------------------- states and crowding

_LEVEL_SQL = f"""WITH {BRAND_PANEL_SQL}, own AS (SELECT code, date, sector, amount, close, coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 0) AS ret FROM panel),
day AS (SELECT date, avg(ret) AS ret FROM own GROUP BY date), lev AS (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date)) AS level FROM day)"""
# Prices of a brand jump from row to row; their hundredth roots make a level that a number can hold.
_DAMPED_SQL = _LEVEL_SQL.replace("coalesce(close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1, 0)", "coalesce(pow(close / lag(close) OVER (PARTITION BY code ORDER BY date), 0.01) - 1, 0)")


def _roll(x: str, how: str, n: int, least: int | None = None) -> str:
    frame = f"OVER (ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {how}({x}) {frame} END"


def _level(spark, sf_dir):
    return regimes.market_level(brand_panel(spark, sf_dir).withColumn("close", F.pow("close", F.lit(0.01))))


@query(f"""{_DAMPED_SQL}, a AS (SELECT *, level / lag(level) OVER (ORDER BY date) - 1 AS r, level / max(level) OVER (ORDER BY date) - 1 AS fall, coalesce(level / lag(level) OVER (ORDER BY date) - 1, 0) AS day FROM lev),
b AS (SELECT *, {_roll('r', 'stddev_samp', 20)} AS vol FROM a),
c AS (SELECT *, {', '.join(f"level / ({_roll('level', 'avg', n, k)}) - 1 AS m{n}_{k}" for n, k in ((250, 20), (40, 10), (250, 250), (120, 120), (60, 60)))}, level / ({_roll('level', 'max', 20, 5)}) - 1 AS t5, level / ({_roll('level', 'max', 20)}) - 1 AS t20,
  {_roll('day', 'sum', 3)} AS day3, {_roll('vol', 'avg', 250)} AS vm, {_roll('vol', 'stddev_samp', 250)} AS vs, {_roll('level', 'max', 20)} AS hi, {_roll('level', 'min', 20)} AS lo, {_roll('level', 'avg', 120)} AS a120 FROM b),
z AS (SELECT date, level, coalesce(m250_20 < 0, FALSE) OR fall < -0.15 AS bear, coalesce(m40_10 < 0, FALSE) OR fall < -0.10 OR day < -0.05 OR coalesce(day3 < -0.08, FALSE) OR coalesce(t5 < -0.10, FALSE) AS bear_fast,
  coalesce(m250_250 < -0.10, FALSE) OR coalesce((vol - vm) / (vs + 1e-9) > 2, FALSE) AS crisis, CASE WHEN m250_250 IS NULL THEN 0 ELSE greatest(least(-m250_250, 0.10), 0) / 0.10 END AS stress,
  coalesce(m120_120 < -0.10, FALSE) OR coalesce(m60_60 < -0.08, FALSE) OR coalesce(t20 < -0.12, FALSE) OR coalesce(vol > 2.5 * nullif(vm, 0), FALSE) AS bear_vote,
  CASE WHEN coalesce(m120_120 < -0.10, FALSE) THEN 'bear' WHEN coalesce(abs(level - a120) / (a120 + 1e-9) < 0.07, FALSE) OR coalesce((hi - lo) / (lo + 1e-9) < 0.12, FALSE) THEN 'osc' ELSE 'bull' END AS label FROM c)
SELECT date, round(ln(level) + {NUDGE}, 6) AS level, bear, bear_fast, crisis, {_sqlr('stress')}, bear_vote, label FROM z""")
def market_states(spark, sf_dir):
    s = regimes.states(_level(spark, sf_dir))
    return s.withColumn("level", F.log("level")).select("date", _r("level"), "bear", "bear_fast", "crisis", _r("stress"), "bear_vote", "label")


@query()
def market_named_states(spark, sf_dir):
    bars = _level(spark, sf_dir).select(F.lit("market").alias("code"), "date", F.col("level").alias("close"))
    return regimes.named_states(regimes.state_features(bars)).select("date", "state", "state_now", "settled", "macd_run")


def _returns(spark, sf_dir):
    p = brand_panel(spark, sf_dir)
    from pyspark.sql import Window as W

    own = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(W.partitionBy("code").orderBy("date"))) - 1, F.lit(0.0))
    return p.withColumn("ret", own)


_CROWD_SQL = f"""{_LEVEL_SQL}, k AS (SELECT *, (rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS p FROM own),
legs AS (SELECT date, avg(amount) FILTER (p >= 0.9 - 1e-9) AS la, avg(amount) FILTER (p <= 0.1 + 1e-9) AS sa, avg(ret) FILTER (p >= 0.9 - 1e-9) AS lr, avg(ret) FILTER (p <= 0.1 + 1e-9) AS sr FROM k GROUP BY date),
raw AS (SELECT date, (({_roll('la', 'avg', 120, 60)}) / (({_roll('sa', 'avg', 120, 60)}) + 1e-8) + ({_roll('lr', 'stddev_samp', 120, 60)}) / (({_roll('sr', 'stddev_samp', 120, 60)}) + 1e-8)) / 2 AS raw FROM legs),
cr AS (SELECT date, (raw - ({_roll('raw', 'avg', 1260, 250)})) / (({_roll('raw', 'stddev_samp', 1260, 250)}) + 1e-8) AS crowding FROM raw)"""


@query(f"""{_CROWD_SQL}, env AS (SELECT date, avg(ret) AS m FROM own GROUP BY date), e AS (SELECT date, CASE WHEN (m - ({_roll('m', 'avg', 1260, 250)})) / (({_roll('m', 'stddev_samp', 1260, 250)}) + 1e-8) > 1.5 THEN 1.0 ELSE 0.0 END AS extreme FROM env),
h AS (SELECT *, list(crowding) FILTER (crowding IS NOT NULL) OVER (ORDER BY date ROWS 1249 PRECEDING) AS held, (crowding - lag(crowding, 5) OVER (ORDER BY date)) / (abs(crowding) + 1e-8) AS roc FROM cr LEFT JOIN e USING (date)),
s AS (SELECT *, CASE WHEN crowding IS NOT NULL AND len(held) >= 250 THEN len(list_filter(held, lambda v: v < crowding)) / len(held) END AS share_below FROM h),
f AS (SELECT *, crowding * extreme AS level_x_extreme, roc * extreme AS roc_x_extreme, CASE WHEN share_below > 0.95 THEN (share_below - 0.95) * -10 ELSE 0 END AS penalty FROM s)
SELECT date, {_sqlr('crowding', 'share_below', 'roc', 'level_x_extreme', 'roc_x_extreme', 'penalty', digits=4)} FROM f""")
def market_crowding(spark, sf_dir):
    p = _returns(spark, sf_dir)
    found = regimes.crowding(p, "close").join(regimes.market_environment(p, "ret").select("date", "extreme"), "date", "left")
    names = ("crowding", "share_below", "roc", "level_x_extreme", "roc_x_extreme", "penalty")
    return regimes.crowding_features(found).select("date", *(_r(n, 4) for n in names))


@query(f"""{_DAMPED_SQL}, s AS (SELECT *, list(level) OVER (ORDER BY date ROWS 1259 PRECEDING) AS held FROM lev), p AS (SELECT date, CASE WHEN len(held) >= 250 THEN len(list_filter(held, lambda v: v >= level)) / len(held) END AS share FROM s)
SELECT date, {_sqlr('share')} FROM p""")
def market_level_share(spark, sf_dir):
    lev = _level(spark, sf_dir)
    return lev.select("date", regimes.share_at_least(lev, "level").alias("share")).select("date", _r("share"))


@query(f"""WITH {BRAND_PANEL_SQL}, b AS (SELECT quantile_disc(close, 0.01) AS lo, quantile_disc(close, 0.99) AS hi, quantile_disc(volume, 0.01) AS vlo, quantile_disc(volume, 0.99) AS vhi FROM panel), c AS (SELECT code, date, least(greatest(close, lo), hi) AS close, least(greatest(volume, vlo), vhi) AS volume FROM panel, b)
SELECT code, date, {_sqlr('close', 'volume', digits=4)} FROM c""")
def panel_winsorized(spark, sf_dir):
    return regimes.winsorize(brand_panel(spark, sf_dir), ["close", "volume"]).select("code", "date", _r("close", 4), _r("volume", 4))


@query(f"""{_LEVEL_SQL}, env AS (SELECT date, avg(ret) AS env_mean, stddev_samp(ret) AS env_std, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS env_rising FROM own GROUP BY date), x AS (SELECT code, date, env_mean * ret AS ix_env_mean__ret, env_std * ret AS ix_env_std__ret, env_rising * ret AS ix_env_rising__ret FROM own JOIN env USING (date))
SELECT code, date, {_sqlr('ix_env_mean__ret', 'ix_env_std__ret', 'ix_env_rising__ret')} FROM x""")
def panel_interactions(spark, sf_dir):
    p, names = _returns(spark, sf_dir), ("ix_env_mean__ret", "ix_env_std__ret", "ix_env_rising__ret")
    return regimes.interactions(p, regimes.market_environment(p, "ret"), ["ret"], ["env_mean", "env_std", "env_rising"]).select("code", "date", *(_r(n) for n in names))


# ---------------------------------------------------------------------------------------------------------------- weights

_CAP = "w0 AS (SELECT code, date, exp(ret - max(ret) OVER (PARTITION BY date)) AS w FROM own)" + "".join(f",\nw{i + 1} AS (SELECT code, date, least(w / sum(w) OVER (PARTITION BY date), 0.05) AS w FROM w{i})" for i in range(optimizers.CAP_ROUNDS))
_WEIGHTS = f"{_LEVEL_SQL}, {_CAP}, wt AS (SELECT code, date, w / sum(w) OVER (PARTITION BY date) AS weight FROM w{optimizers.CAP_ROUNDS})"


@query(f"{_WEIGHTS} SELECT code, date, {_sqlr('weight')} FROM wt")
def weights_capped(spark, sf_dir):
    return optimizers.capped_weights(_returns(spark, sf_dir), "ret").select("code", "date", _r("weight"))


@query(f"""{_WEIGHTS}, bf AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY code ORDER BY date), 0) AS before FROM wt), mv AS (SELECT *, sum(abs(weight - before)) OVER (PARTITION BY date) AS moved FROM bf), kp AS (SELECT *, CASE WHEN moved > 1e-12 THEN greatest(0, 1 - 0.3 / moved) ELSE 0 END AS keep FROM mv),
nw AS (SELECT code, date, greatest(weight * (1 - keep) + before * keep, 0) AS w FROM kp), nm AS (SELECT code, date, w / (sum(w) OVER (PARTITION BY date) + 1e-12) AS weight FROM nw) SELECT code, date, {_sqlr('weight')} FROM nm""")
def weights_turnover(spark, sf_dir):
    from pyspark.sql import Window as W

    w = optimizers.capped_weights(_returns(spark, sf_dir), "ret").withColumn("before", F.coalesce(F.lag("weight").over(W.partitionBy("code").orderBy("date")), F.lit(0.0)))
    return optimizers.shrink_turnover(w, "before", 0.3).select("code", "date", _r("weight"))


@query()
def weights_grouped(spark, sf_dir):
    return optimizers.grouped_weights(_returns(spark, sf_dir), "ret", "sector", "amount", 0.2).select("date", "code", _r("weight"))


def _covariance(method: str):
    def run(spark, sf_dir):
        return optimizers.covariance_weights(_returns(spark, sf_dir), "ret", method).select("date", "code", _r("weight", 5))

    run.__name__ = f"weights_{method}"
    return run


for _method in optimizers.METHODS:
    query()(_covariance(_method))


@query()
def market_absorption(spark, sf_dir):
    months = _returns(spark, sf_dir).groupBy(F.trunc("date", "month").alias("date"), "code").agg(F.avg("ret").alias("ret"))
    return optimizers.absorption(months, "ret", 24, 1).select("date", _r("absorption"))


@query(f"""{_LEVEL_SQL}, v AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol FROM own WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)), i AS (SELECT *, 1 / (vol + 1e-10) AS inv FROM v),
s AS (SELECT code, date, greatest(-1, least(1, sign(ret) * 0.5 * inv / sum(inv) OVER (PARTITION BY date) * count(vol) OVER (PARTITION BY date))) AS scaled, inv FROM i) SELECT code, date, CASE WHEN inv IS NOT NULL THEN round(scaled + {NUDGE}, 6) END AS scaled FROM s""")
def signal_inverse_volatility(spark, sf_dir):
    p = _returns(spark, sf_dir).withColumn("signal", F.signum("ret") * 0.5)
    out = optimizers.scaled_signals(p, "signal", "ret")
    return out.select("code", "date", _r("scaled"))


@query()
def chip_structure(spark, sf_dir):
    from pyspark.sql import Window as W

    p = brand_panel(spark, sf_dir)
    share = 100 * F.try_divide("volume", F.sum("volume").over(W.partitionBy("code").orderBy("date").rowsBetween(-59, 0)))
    return chips.chip_structure(p.withColumn("turnover", share)).select("code", "date", *(_r(n, 4) for n in chips.FIELDS))


# ---------------------------------------------------------------------------------------------------------------- market rules

_SYMBOLS = ("600000.SH", "300750.SZ", "688001.sh", "830799.BJ", "AAPL.US", "0700.HK", "BTC-USDT", "eth/usdt", "IF2406.CFFEX", "rb2410.SHFE", "ESZ4", "CL2412", "GC.CME", "EUR/USD", "USDJPY.FX", "RB2410", "m2412", "6E.CME", "xx")
_CHINA, _WORLD, _FX = ("IF2406.CFFEX", "rb2410.SHFE", "au2412", "TS2406.CFFEX", "lh2411.DCE", "zz2401.DCE"), ("ESZ4", "CL2412", "GC.CME", "ZBH25", "6E.CME", "XY2501"), ("EUR/USD", "USDJPY.FX", "GBPUSD", "EUR/SEK")


def _pick(names: tuple[str, ...], key: str):
    return F.element_at(F.array(*(F.lit(n) for n in names)), (F.col(key) % len(names) + 1).cast("int"))


def _sql_pick(names: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} % {len(names)} AS INT) + 1]"


_FORMS = " ".join(f"WHEN regexp_matches(s, '{f}') THEN '{m}'" for f, m in market_rules.FORMS)
_BARE = ", ".join(repr(p) for p in market_rules.CHINA_PRODUCTS.upper().split())
_EXCHANGES = ", ".join(repr(p) for p in market_rules.CHINA_EXCHANGES)


@query(f"""WITH s AS (SELECT o_orderkey AS id, {_sql_pick(_SYMBOLS, 'o_orderkey')} AS s, o_totalprice AS amount FROM orders), m AS (SELECT *, CASE {_FORMS} ELSE 'a_share' END AS market, split_part(s, '.', 1) AS head FROM s),
f AS (SELECT *, CASE WHEN market = 'hk_equity' THEN amount * 0.00015 + amount * 0.001 + amount * 0.0000565 + amount * 0.00002 ELSE 0 END AS fee, CASE WHEN market IN ('a_share', 'hk_equity') THEN floor(amount / 100) * 100 WHEN market = 'futures' THEN floor(amount) WHEN market = 'forex' THEN floor(amount / 1000) * 1000 ELSE amount END AS size FROM m)
SELECT id, s AS symbol, market, CASE WHEN len(string_split(s, '.')) = 2 THEN upper(split_part(s, '.', 2)) IN ({_EXCHANGES}) ELSE regexp_extract(upper(s), '^([A-Z]+)[0-9]+', 1) IN ({_BARE}) END AS china,
  CASE WHEN starts_with(head, '300') OR starts_with(head, '688') THEN 0.2 WHEN starts_with(head, '8') AND length(head) = 6 THEN 0.3 ELSE 0.1 END AS board, {_sqlr('fee', 'size', digits=3)} FROM f""")
def rules_symbols(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(_SYMBOLS, "o_orderkey").alias("symbol"), F.col("o_totalprice").cast("double").alias("amount"))
    s = F.col("symbol")
    p = o.withColumn("market", market_rules.market_of(s))
    size = F.when(F.col("market").isin("us_equity", "crypto"), F.col("amount")).otherwise(market_rules.lots(F.col("amount"), F.col("market")))
    p = p.withColumns({"fee": market_rules.equity_fee(F.col("amount"), F.col("market")), "size": size})
    return p.select("id", "symbol", "market", market_rules.is_china_future(s).alias("china"), market_rules.board_limit(s).alias("board"), _r("fee", 3), _r("size", 3))


def _terms_sql(text: str, defaults: tuple) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in market_rules._rows(text, defaults))


_LINES_SQL = "SELECT l_orderkey AS id, l_linenumber AS line, {} AS symbol, CAST(l_quantity AS DOUBLE) AS size, CAST(l_extendedprice AS DOUBLE) / nullif(l_quantity, 0) AS price, l_discount * 2 - 0.1 AS change, CASE WHEN l_linenumber % 3 = 2 THEN -1 ELSE l_linenumber % 3 END AS direction, CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS held FROM lineitem"
_MAY = "NOT coalesce(CASE WHEN direction = 1 THEN change >= price_limit - 0.001 WHEN direction = -1 THEN change <= 0.001 - price_limit WHEN held > 0 THEN change <= 0.001 - price_limit ELSE change >= price_limit - 0.001 END, FALSE)"


def _lines(spark, sf_dir, names: tuple[str, ...]):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    three = F.col("l_linenumber") % 3
    return l.select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), _pick(names, "l_partkey").alias("symbol"), F.col("l_quantity").cast("double").alias("size"), F.try_divide(F.col("l_extendedprice").cast("double"), "l_quantity").alias("price"),
        (F.col("l_discount") * 2 - 0.1).alias("change"), F.when(three == 2, -1).otherwise(three).alias("direction"), F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1).alias("held"),
    )


@query(f"""WITH terms(product, multiplier, margin_rate, price_limit, fee_rate, fee_lot) AS (VALUES {_terms_sql(market_rules.CHINA_CONTRACTS, market_rules.CHINA_DEFAULTS)}), l AS ({_LINES_SQL.format(_sql_pick(_CHINA, 'l_partkey'))}),
j AS (SELECT l.*, regexp_extract(symbol, '^([A-Za-z]+)', 1) AS product, coalesce(multiplier, 10) AS multiplier, coalesce(margin_rate, 0.1) AS margin_rate, coalesce(price_limit, 0.05) AS price_limit, CASE WHEN t.product IS NULL THEN 0 ELSE fee_rate END AS fee_rate, CASE WHEN t.product IS NULL THEN 5 ELSE fee_lot END AS fee_lot
  FROM l LEFT JOIN terms t ON t.product = regexp_extract(symbol, '^([A-Za-z]+)', 1)),
f AS (SELECT *, size * price * multiplier * fee_rate + size * fee_lot AS fee, size * price * multiplier * margin_rate AS margin, held * size * (price * (1 + change) - price) * multiplier AS pnl FROM j) SELECT id, line, symbol, product, {_sqlr('fee', 'margin', 'pnl', digits=2)}, {_MAY} AS may FROM f""")
def rules_china_futures(spark, sf_dir):
    p = market_rules.with_contract(_lines(spark, sf_dir, _CHINA), True)
    c = F.col
    p = p.withColumns({
        "fee": market_rules.contract_fee(c("size"), c("price"), c("multiplier"), c("fee_rate"), c("fee_lot")), "margin": market_rules.contract_margin(c("size"), c("price"), c("multiplier"), 1 / c("margin_rate")),
        "pnl": market_rules.contract_pnl(c("held"), c("size"), c("price"), c("price") * (1 + c("change")), c("multiplier")), "may": market_rules.may_trade(c("direction"), c("change"), c("price_limit"), c("held")),
    })
    return p.select("id", "line", "symbol", "product", _r("fee", 2), _r("margin", 2), _r("pnl", 2), "may")


_WORLD_PRODUCT = "CASE WHEN regexp_matches(head, '^[A-Z]{2,4}[FGHJKMNQUVXZ][0-9]{1,4}$') THEN regexp_extract(head, '^([A-Z]{2,4})[FGHJKMNQUVXZ][0-9]{1,4}$', 1) WHEN regexp_matches(head, '^[A-Z]') THEN regexp_extract(head, '^([A-Z]+)', 1) ELSE head END"


@query(f"""WITH terms(product, multiplier, margin, price_limit, fee_lot) AS (VALUES {_terms_sql(market_rules.GLOBAL_CONTRACTS, market_rules.GLOBAL_DEFAULTS)}), l AS ({_LINES_SQL.format(_sql_pick(_WORLD, 'l_partkey'))}), h AS (SELECT *, upper(split_part(symbol, '.', 1)) AS head FROM l), n AS (SELECT *, {_WORLD_PRODUCT} AS product FROM h),
j AS (SELECT n.*, coalesce(multiplier, 50) AS multiplier, price_limit, margin, CASE WHEN t.product IS NULL THEN 2.5 ELSE fee_lot END AS fee_lot FROM n LEFT JOIN terms t USING (product)), f AS (SELECT *, size * fee_lot AS fee, size * margin AS deposit, held * size * (price * (1 + change) - price) * multiplier AS pnl FROM j)
SELECT id, line, symbol, product, {_sqlr('fee', 'deposit', 'pnl', digits=2)}, {_MAY} AS may FROM f""")
def rules_global_futures(spark, sf_dir):
    p = market_rules.with_contract(_lines(spark, sf_dir, _WORLD), False)
    c = F.col
    p = p.withColumns({"fee": market_rules.contract_fee(c("size"), c("price"), c("multiplier"), F.lit(0.0), c("fee_lot")), "deposit": c("size") * c("margin"), "pnl": market_rules.contract_pnl(c("held"), c("size"), c("price"), c("price") * (1 + c("change")), c("multiplier")), "may": market_rules.may_trade(c("direction"), c("change"), c("price_limit"), c("held"))})
    return p.select("id", "line", "symbol", "product", _r("fee", 2), _r("deposit", 2), _r("pnl", 2), "may")


_TIERS = " ".join(f"WHEN size * close <= {m} THEN {r}" for m, r in market_rules.TIERS)
_POSITIONS = "SELECT event_id AS id, ts, {} AS symbol, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS direction, CAST(value * 50 AS DOUBLE) AS size, CAST(value AS DOUBLE) AS close, CAST(value * (1 + (event_id % 21 - 10) / 100.0) AS DOUBLE) AS entry FROM events"


def _positions(spark, sf_dir, names: tuple[str, ...]):
    value = F.col("value").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", _pick(names, "user_id").alias("symbol"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1).alias("direction"), (value * 50).alias("size"), value.alias("close"), (value * (1 + (F.col("event_id") % 21 - 10) / 100.0)).alias("entry")
    )


@query(f"""WITH p AS ({_POSITIONS.format(_sql_pick(('BTC-USDT', 'ETH-USDT', 'SOL-USDT'), 'user_id'))}), h AS (SELECT *, CASE WHEN hour(ts) IN (0, 8, 16) THEN hour(ts) ELSE -1 END AS slot, CAST(ts AS DATE) AS day FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, slot ORDER BY ts, id) AS n, CASE {_TIERS} ELSE 0.1 END AS rate FROM h), f AS (SELECT *, CASE WHEN n = 1 THEN size * close * 0.0001 * direction ELSE 0 END AS funding FROM r)
SELECT id, symbol, {_sqlr('funding')}, rate AS maintenance, coalesce(size * entry / 10 + direction * size * (close - entry) <= size * close * rate, FALSE) AS liquidated FROM f""")
def rules_funding(spark, sf_dir):
    p = market_rules.with_funding(_positions(spark, sf_dir, ("BTC-USDT", "ETH-USDT", "SOL-USDT")), order=("id",))
    c = F.col
    gone = market_rules.liquidated(c("direction"), c("size"), c("entry"), c("close"), F.lit(10.0))
    return p.select("id", "symbol", _r("funding"), market_rules.maintenance_rate(c("size") * c("close")).alias("maintenance"), gone.alias("liquidated"))


def _pair_case(place: int) -> str:
    return "CASE pair " + " ".join(f"WHEN '{p[0]}' THEN {p[place + 1]}" for p in market_rules.PAIRS) + f" ELSE {market_rules.PAIR_DEFAULTS[place]} END"


@query(f"""WITH p AS ({_POSITIONS.format(_sql_pick(_FX, 'user_id'))}), c AS (SELECT *, replace(symbol, '.FX', '') AS s FROM p), k AS (SELECT *, CASE WHEN contains(s, '/') THEN s ELSE s[1:3] || '/' || s[4:6] END AS pair, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, id) AS n FROM c),
f AS (SELECT id, symbol, CASE WHEN n = 1 THEN size / 100000 * CASE WHEN direction = 1 THEN {_pair_case(1)} ELSE {_pair_case(2)} END * CASE WHEN isodow(ts) = 3 THEN 3 ELSE 1 END ELSE 0 END AS swap, close + direction * ({_pair_case(0)} / 2 + 0.3) * CASE WHEN pair LIKE '%/JPY' THEN 0.01 ELSE 0.0001 END AS paid FROM k) SELECT id, symbol, {_sqlr('swap', 'paid')} FROM f""")
def rules_swap(spark, sf_dir):
    p = market_rules.with_swap(_positions(spark, sf_dir, _FX), order=("id",))
    return p.withColumn("paid", market_rules.slipped(F.col("close"), F.col("direction"), F.lit("forex"), F.col("symbol"))).select("id", "symbol", _r("swap"), _r("paid"))


# ---------------------------------------------------------------------------------------------------------------- signals


@query(f"""WITH {BRAND_PANEL_SQL}, m AS (SELECT code, date, CASE WHEN month(date) IN (5, 6, 7, 8, 9) THEN -1 WHEN month(date) IN (1, 2, 3, 11, 12) THEN 1 ELSE 0 END AS month, CASE WHEN isodow(date) = 1 THEN -1 WHEN isodow(date) = 5 THEN 1 ELSE 0 END AS day FROM panel)
SELECT code, date, month, CASE WHEN month <> 0 AND month = day THEN month ELSE 0 END AS both_agree FROM m""")
def signal_seasonal(spark, sf_dir):
    return brand_panel(spark, sf_dir).select("code", "date", signals.seasonal(F.col("date")).alias("month"), signals.seasonal(F.col("date"), True).alias("both_agree"))


@query(f"""WITH {BRAND_PANEL_SQL}, r AS (SELECT date, a.close / b.close AS r FROM panel a JOIN panel b USING (date) WHERE a.code = 'Brand#11' AND b.code = 'Brand#12'), z AS (SELECT date, CASE WHEN count(r) OVER w = 60 THEN (r - avg(r) OVER w) / stddev_samp(r) OVER w END AS z FROM r WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))
SELECT date, {_sqlr('z')}, CASE WHEN z < -2 THEN 0.5 WHEN z > 2 THEN -0.5 ELSE 0 END AS signal_a, -CASE WHEN z < -2 THEN 0.5 WHEN z > 2 THEN -0.5 ELSE 0 END AS signal_b FROM z""")
def signal_pair(spark, sf_dir):
    return signals.pair(brand_panel(spark, sf_dir), "Brand#11", "Brand#12").select("date", _r("z"), "signal_a", "signal_b")


@query()
def signal_vote(spark, sf_dir):
    return signals.vote(brand_panel(spark, sf_dir))
