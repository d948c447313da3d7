"""Registered queries of factor sets chosen and followed, sums by theme, and shadow accounts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.expr import NUDGE, Compiler
from .operators import frozen, joins, research, shadow, strategies
from .operators.bench import bench, daily_ics
from .operators.correlations import factor_correlation
from .plans.panel import BRAND_PANEL_SQL, brand_panel, table
from .queries import _PAIR, _TRIPS, MOMENTUM, _r, _sqlr, journal, query

_FACTORS = {**_PAIR, "label": MOMENTUM["label"]}
_NAMES = list(_PAIR)
SPLIT = "1996-01-01"
THEMES = {"mom5": ["momentum", "price"], "low_vol": ["risk", "price"], "size": []}

_WIDE_SQL = "WITH " + BRAND_PANEL_SQL.replace("panel AS", "panel0 AS", 1) + ",\nwide AS (" + Compiler(_FACTORS).to_sql("panel AS (SELECT * FROM panel0)", digits=None).replace("WITH panel AS (SELECT * FROM panel0),\n", "WITH ").replace(" FROM panel)", " FROM panel0)") + "),\nlong AS (" + " UNION ALL ".join(f"SELECT date, code, '{n}' AS factor, {n} AS value, label FROM wide" for n in _NAMES) + ")"
_ORD_SQL = f"""{_WIDE_SQL},
place AS (SELECT factor, date, CASE WHEN value IS NOT NULL THEN row_number() OVER (PARTITION BY factor, date ORDER BY value NULLS LAST, code) END AS f, CASE WHEN label IS NOT NULL THEN row_number() OVER (PARTITION BY factor, date ORDER BY label NULLS LAST, code) END AS y FROM long),
ics AS (SELECT factor, date, corr(f, y) AS ic FROM place WHERE f IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)"""
_SPLIT_SQL = f"""{_ORD_SQL},
s AS (SELECT factor, {', '.join(f"avg(ic) FILTER (date {op} DATE '{SPLIT}') AS {n}_ic, CASE WHEN stddev_samp(ic) FILTER (date {op} DATE '{SPLIT}') > 0 THEN avg(ic) FILTER (date {op} DATE '{SPLIT}') / stddev_samp(ic) FILTER (date {op} DATE '{SPLIT}') ELSE 0 END AS {n}_ir" for n, op in (('before', '<='), ('after', '>=')))} FROM ics GROUP BY 1),
scores AS (SELECT *, coalesce(before_ic > 0 AND before_ir > 0, FALSE) AS alive FROM s)"""
_BLEND_SQL = f"""{_SPLIT_SQL}, w AS (SELECT factor, abs(before_ir) AS w FROM scores WHERE alive),
blended AS (SELECT date, code, sum(w * coalesce(value, 0)) / (SELECT sum(w) FROM w) AS signal FROM long JOIN w USING (factor) GROUP BY 1, 2)"""


def _wide(spark, sf_dir):
    return Compiler(_FACTORS).apply(brand_panel(spark, sf_dir))


def _long(spark, sf_dir):
    return frozen.long_rows(_wide(spark, sf_dir), _NAMES)


def _scores(spark, sf_dir):
    return frozen.split_scores(frozen.ordinal_ics(_long(spark, sf_dir)), SPLIT)


def _themes(spark):
    return spark.createDataFrame(list(THEMES.items()), "factor string, themes array<string>")


_THEMES_SQL = "themes(factor, theme) AS (VALUES " + ", ".join(f"('{f}', '{t}')" for f, ts in THEMES.items() for t in (ts or ["uncategorised"])) + ")"


@query(f"{_SPLIT_SQL} SELECT factor, {_sqlr('before_ic', 'before_ir', 'after_ic', 'after_ir')}, alive FROM scores")
def frozen_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("factor", *(_r(c) for c in ("before_ic", "before_ir", "after_ic", "after_ir")), "alive")


@query(f"{_BLEND_SQL} SELECT date, code, {_sqlr('signal', digits=4)} FROM blended")
def frozen_signal(spark, sf_dir):
    return frozen.blend(_long(spark, sf_dir), _scores(spark, sf_dir)).select("date", "code", _r("signal", 4))


@query(f"""{_ORD_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS n FROM ics),
d AS (SELECT factor, CASE WHEN count(*) FILTER (n <= 60) >= 20 THEN avg(ic) FILTER (n <= 60) END AS recent_ic, CASE WHEN count(*) FILTER (n <= 250) >= 60 THEN avg(ic) FILTER (n <= 250) END AS base_ic FROM n GROUP BY 1)
SELECT factor, {_sqlr('recent_ic', 'base_ic')}, coalesce(recent_ic < 0, FALSE) OR coalesce(base_ic > 0 AND recent_ic < base_ic * 0.3, FALSE) AS decayed FROM d""")
def frozen_decay(spark, sf_dir):
    return frozen.decay(frozen.ordinal_ics(_long(spark, sf_dir))).select("factor", _r("recent_ic"), _r("base_ic"), "decayed")


def _top_sql(name: str, signal: str) -> str:
    return f"""{name}0 AS (SELECT date, code, {signal} AS s, label AS y FROM wide JOIN nth USING (date) WHERE ({signal}) IS NOT NULL AND label IS NOT NULL), {name}1 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY s DESC, code) AS place FROM {name}0),
{name} AS (SELECT date, avg(y) - CAST(0.3 AS DOUBLE) * 2 * 0.001 AS ret, count(*) AS n_held FROM {name}1 WHERE n >= 5 AND place <= greatest(3, floor(n * CAST(0.3 AS DOUBLE))) GROUP BY date)"""


_NTH_SQL = "nth AS (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM wide)) WHERE (i - 1) % 5 = 0)"
_CHANCE_SQL = "md5('7|' || CAST(date AS VARCHAR) || '|' || code)"


@query(f"{_WIDE_SQL}, {_NTH_SQL}, {_top_sql('port', 'mom5')}, {_top_sql('chance', _CHANCE_SQL)} SELECT date, {_sqlr('ret')}, n_held, 'signal' AS by FROM port UNION ALL SELECT date, {_sqlr('ret')}, n_held, 'chance' FROM chance")
def frozen_top_share(spark, sf_dir):
    p = _wide(spark, sf_dir)
    top = lambda s, name: frozen.top_share(p, s).select("date", _r("ret"), "n_held", F.lit(name).alias("by"))
    return top(F.col("mom5"), "signal").unionByName(top(frozen.by_chance(7), "chance"))


@query(f"""{_WIDE_SQL} {''.join(f", c_{n} AS (SELECT count({n}) / (count(DISTINCT date) * count(DISTINCT code)) AS coverage FROM wide)" for n in _NAMES)}
{' UNION ALL '.join(f"SELECT '{n}' AS factor, {_sqlr('coverage')} FROM c_{n}" for n in _NAMES)}""")
def frozen_coverage(spark, sf_dir):
    return frozen.coverage(_wide(spark, sf_dir), _NAMES).select("factor", _r("coverage"))


_PCT = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date) END"


@query(f"""{_WIDE_SQL}, px AS (SELECT w.date, w.code, mom5 AS f, close FROM wide w JOIN panel0 USING (date, code)), h AS (SELECT *, {', '.join(f"lead(close, {h}) OVER (PARTITION BY code ORDER BY date) / close - 1 AS h{h}" for h in (5, 20, 60))} FROM px),
r AS (SELECT date, {_PCT.format('f')} AS f, {', '.join(f"{_PCT.format(f'h{h}')} AS h{h}" for h in (5, 20, 60))} FROM h),
d AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, date, CASE WHEN count(*) >= 20 AND stddev_samp(f) > 1e-13 AND stddev_samp(h{h}) > 1e-13 THEN covar_samp(f, h{h}) / (stddev_samp(f) * stddev_samp(h{h})) END AS ic FROM r WHERE f IS NOT NULL AND h{h} IS NOT NULL GROUP BY date" for h in (5, 20, 60))}),
s AS (SELECT horizon, avg(ic) AS m, stddev_pop(ic) AS sd, count(ic) AS n FROM d GROUP BY 1), o AS (SELECT horizon, CASE WHEN n >= 10 THEN m ELSE 0 END AS ic, CASE WHEN n >= 10 AND sd > 0 THEN m / sd ELSE 0 END AS icir, CASE WHEN n >= 10 THEN n ELSE 0 END AS n FROM s) SELECT horizon, {_sqlr('ic', 'icir')}, n FROM o""")
def frozen_horizons(spark, sf_dir):
    own = brand_panel(spark, sf_dir).select("date", "code", "close").join(_wide(spark, sf_dir).select("date", "code", "mom5"), ["date", "code"])
    return frozen.horizon_scores(own, "mom5").select("horizon", _r("ic"), _r("icir"), "n")


@query(f"""{_WIDE_SQL}, {_THEMES_SQL}, k AS (SELECT factor, date, (rank() OVER (PARTITION BY factor, date ORDER BY value) + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0) AS f, (rank() OVER (PARTITION BY factor, date ORDER BY label) + (count(*) OVER (PARTITION BY factor, date, label) - 1) / 2.0) AS y FROM long WHERE value IS NOT NULL AND label IS NOT NULL),
i AS (SELECT factor, date, covar_samp(f, y) / (stddev_samp(f) * stddev_samp(y)) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(f) > 1e-9 AND stddev_samp(y) > 1e-9),
b AS (SELECT factor, avg(ic) AS m, stddev_samp(ic) AS sd, count(*) AS n, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS pos FROM i GROUP BY 1),
c AS (SELECT factor, CASE WHEN m > 0.02 AND pos >= 0.55 AND abs(m / (sd / sqrt(n))) > 2 THEN 'alive' WHEN m < -0.02 AND abs(m / (sd / sqrt(n))) > 2 THEN 'reversed' ELSE 'dead' END AS category FROM b)
SELECT theme, count(*) FILTER (category = 'alive') AS alive, count(*) FILTER (category = 'reversed') AS reversed, count(*) FILTER (category = 'dead') AS dead, count(*) AS count FROM c JOIN themes USING (factor) GROUP BY theme""")
def theme_verdicts(spark, sf_dir):
    rows = bench(daily_ics(_long(spark, sf_dir).where("value IS NOT NULL AND label IS NOT NULL")))
    return frozen.theme_counts(rows, _themes(spark))


def _ranks_sql(a: str, b: str) -> str:
    one = lambda x: _PCT.format(x)
    return f"SELECT '{a}' AS a, '{b}' AS b, avg(c) AS corr FROM (SELECT date, covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS c FROM (SELECT date, {one(a)} AS x, {one(b)} AS y FROM wide) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY date HAVING stddev_samp(x) > 1e-13 AND stddev_samp(y) > 1e-13)"


_CORR_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]]


@query(f"""{_WIDE_SQL}, {_THEMES_SQL}, p AS ({' UNION ALL '.join(_ranks_sql(a, b) for a, b in _CORR_PAIRS)}), both_ways AS (SELECT * FROM p UNION ALL SELECT b, a, corr FROM p),
t AS (SELECT x.theme AS theme_a, y.theme AS theme_b, avg(abs(corr)) AS corr FROM both_ways JOIN themes x ON x.factor = a JOIN themes y ON y.factor = b WHERE corr IS NOT NULL GROUP BY 1, 2) SELECT theme_a, theme_b, {_sqlr('corr')} FROM t""")
def theme_overlap(spark, sf_dir):
    return frozen.theme_correlations(factor_correlation(_wide(spark, sf_dir), _NAMES), _themes(spark)).select("theme_a", "theme_b", _r("corr"))


@query("SELECT l_returnflag AS exit_reason, count(*) AS n_trades, round(sum(CAST(l_extendedprice AS DOUBLE) * (0.05 - l_discount)) + 1.7e-8, 2) AS total_pnl FROM lineitem GROUP BY 1")
def journal_exit_reasons(spark, sf_dir):
    trades = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("exit_reason"), (F.col("l_extendedprice").cast("double") * (0.05 - F.col("l_discount"))).alias("pnl"))
    return frozen.exit_reasons(trades).select("exit_reason", "n_trades", _r("total_pnl", 2))


# ---------------------------------------------------------------------------------------------------------------- shadow accounts

LOW, HIGH, TYPICAL = 1.0, 5.0, 2.0


def _trips(spark, sf_dir):
    return joins.fifo_lots(journal(spark, sf_dir))


@query(f"""WITH {_TRIPS}, spans AS (SELECT *, (epoch_us(sell_at) - epoch_us(buy_at)) / 86400000000.0 AS hold FROM trips),
marked AS (SELECT *, CASE WHEN hold < {LOW} OR hold > {HIGH} THEN -pnl ELSE 0 END AS noise, CASE WHEN pnl > 0 AND hold < {LOW} THEN pnl * ({LOW} - hold) / {LOW} ELSE 0 END AS early, CASE WHEN pnl < 0 AND hold > {HIGH} THEN -pnl * (hold - {HIGH}) / {HIGH} ELSE 0 END AS late FROM spans),
placed AS (SELECT pnl, row_number() OVER (ORDER BY abs(pnl), pnl) AS i, floor(greatest(count(*) OVER () - greatest(1.0, (epoch_us(max(sell_at) OVER ()) - epoch_us(min(buy_at) OVER ())) / 86400000000.0 / {2 * TYPICAL}), 0)) AS extra FROM trips),
sums AS (SELECT sum(pnl) AS real_pnl, sum(noise) AS noise, sum(early) AS early_exit, sum(late) AS late_exit, coalesce((SELECT -sum(pnl) FROM placed WHERE i <= extra), 0) AS overtrading FROM marked) SELECT {_sqlr('real_pnl', 'noise', 'early_exit', 'late_exit', 'overtrading', digits=2)}, round(1000 - real_pnl - noise - early_exit - late_exit - overtrading + {NUDGE}, 2) AS missed FROM sums""")
def shadow_attribution(spark, sf_dir):
    names = ("real_pnl", "noise", "early_exit", "late_exit", "overtrading", "missed")
    return shadow.attribution(_trips(spark, sf_dir), LOW, HIGH, TYPICAL, 1000.0).select(*(_r(n, 2) for n in names))


@query()
def shadow_rules(spark, sf_dir):
    trips = _trips(spark, sf_dir)
    markets = trips.select("symbol").distinct().withColumn("market", F.when(F.col("symbol") % 2 == 0, "us_equity").otherwise("crypto"))
    return shadow.rules(shadow.clusters(shadow.trip_features(trips, markets)))


@query(f"""WITH {BRAND_PANEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS i FROM panel),
f AS (SELECT code, count(*) AS bars, max(date) AS date, max(close) FILTER (i = 1) / arg_max(close, i) FILTER (i <= 6) - 1 AS momentum, max(close) FILTER (i = 1) > avg(close) FILTER (i <= 20) AS price_above_ma, max(volume) FILTER (i = 1) / avg(volume) FILTER (i BETWEEN 2 AND 6) AS volume_ratio FROM n GROUP BY code)
SELECT code, bars, date, {_sqlr('momentum', 'volume_ratio')}, price_above_ma, momentum > 0 AND price_above_ma AND coalesce(volume_ratio > 1, TRUE) AS rises FROM f WHERE bars >= 2""")
def shadow_last_bars(spark, sf_dir):
    f = shadow.last_bar_features(brand_panel(spark, sf_dir))
    return f.select("code", "bars", "date", _r("momentum"), _r("volume_ratio"), "price_above_ma", shadow.meets({}).alias("rises"))


@query(f"""WITH {BRAND_PANEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS i FROM panel),
f AS (SELECT code, max(sector) FILTER (i = 1) AS market, count(*) AS bars, max(close) FILTER (i = 1) / arg_max(close, i) FILTER (i <= 6) - 1 AS momentum, max(volume) FILTER (i = 1) / avg(volume) FILTER (i BETWEEN 2 AND 6) AS volume_ratio FROM n GROUP BY code),
h AS (SELECT 'rising' AS rule, market, code FROM f WHERE bars >= 2 AND momentum >= 0 AND market = 1 UNION ALL SELECT 'quiet', market, code FROM f WHERE bars >= 2 AND volume_ratio <= 1.5 AND market = 2)
SELECT rule, market, code FROM h QUALIFY row_number() OVER (PARTITION BY rule, market ORDER BY code) <= 3""")
def shadow_scan(spark, sf_dir):
    p = brand_panel(spark, sf_dir)
    latest = p.groupBy("code").agg(F.max_by("sector", "date").alias("market"))
    bars = shadow.last_bar_features(p).join(latest, "code")
    return shadow.scan(bars, {"rising": (1, {"momentum": (0.0, None)}), "quiet": (2, {"volume_ratio": (None, 1.5)})})


# ---------------------------------------------------------------------------------------------------------------- strategies

_CHAIN_SQL = "k0 AS (SELECT *, TRUE AS go FROM wide)" + "".join(
    f""", n{i} AS (SELECT * EXCLUDE (go), go AND count({s}) OVER (PARTITION BY date) >= 3 AS go, count({s}) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY {s} DESC NULLS LAST, code) AS place FROM k{i}),
k{i + 1} AS (SELECT * EXCLUDE (n, place) FROM n{i} WHERE NOT go OR ({s} IS NOT NULL AND place <= greatest(2, floor(n * 0.5))))"""
    for i, s in enumerate(_NAMES)
)


@query(f"{_WIDE_SQL}, {_CHAIN_SQL}, c AS (SELECT date, avg(coalesce(label, 0)) AS ret, count(*) AS n_held FROM k{len(_NAMES)} GROUP BY date HAVING count(*) >= 2) SELECT date, {_sqlr('ret')}, n_held FROM c")
def strategy_keep_chain(spark, sf_dir):
    return strategies.keep_chain(_wide(spark, sf_dir), _NAMES).select("date", _r("ret"), "n_held")


@query(f"""{_WIDE_SQL}, k AS (SELECT greatest(1, floor(count(DISTINCT code) * CAST(0.1 AS DOUBLE))) AS k FROM wide), u AS (SELECT date, size AS s, row_number() OVER (PARTITION BY date ORDER BY size DESC, code) AS up, row_number() OVER (PARTITION BY date ORDER BY size, code) AS down FROM wide WHERE size IS NOT NULL),
g AS (SELECT date, avg(s) FILTER (up <= k) - avg(s) FILTER (down <= k) AS spread FROM u, k GROUP BY date), z AS (SELECT date, spread, CASE WHEN count(spread) OVER w >= 60 THEN (spread - avg(spread) OVER w) / (stddev_samp(spread) OVER w + 1e-9) END AS z FROM g WINDOW w AS (ORDER BY date ROWS 251 PRECEDING))
SELECT date, {_sqlr('spread')}, CASE WHEN z IS NOT NULL THEN round(greatest(0, least(1, z)) + {NUDGE}, 6) END AS scale FROM z""")
def strategy_signal_strength(spark, sf_dir):
    return strategies.signal_strength(_wide(spark, sf_dir), "size").select("date", _r("spread"), _r("scale"))


# labels of the brand panel jump; their logarithms are returns of a usual size
_LOGS_SQL = "port AS (SELECT date, avg(ln(1 + label)) / 100 AS ret FROM wide WHERE mom5 > 0 AND label IS NOT NULL GROUP BY date), idx AS (SELECT date, avg(ln(1 + label)) / 100 AS x FROM wide WHERE label IS NOT NULL GROUP BY date), j AS (SELECT date, ret, coalesce(x, 0) AS x FROM port LEFT JOIN idx USING (date))"


@query(f"""{_WIDE_SQL}, {_LOGS_SQL}, o AS (SELECT covar_samp(ret, x) / (var_pop(x) + 1e-12) AS b FROM j), r AS (SELECT *, CASE WHEN count(x) OVER w = 60 THEN covar_samp(ret, x) OVER w / var_samp(x) OVER w END AS own FROM j WINDOW w AS (ORDER BY date ROWS 59 PRECEDING)),
f AS (SELECT date, ret, x, coalesce(own, first_value(own IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rolling FROM r), h AS (SELECT 'ols' AS method, date, b AS beta, ret - b * x AS net FROM j, o UNION ALL SELECT 'rolling', date, rolling, ret - rolling * x FROM f UNION ALL SELECT 'subtract', date, 1.0, ret - x FROM j)
SELECT method, date, {_sqlr('beta', 'net')} FROM h""")
def strategy_hedged(spark, sf_dir):
    p = _wide(spark, sf_dir).where("label IS NOT NULL").withColumn("_y", F.log1p("label") / 100)
    port, index = (x.groupBy("date").agg(F.avg("_y").alias("ret")) for x in (p.where("mom5 > 0"), p))
    one = lambda m: strategies.hedged(port, index, m).select(F.lit(m).alias("method"), "date", _r("beta"), _r("net"))
    return one("ols").unionByName(one("rolling")).unionByName(one("subtract"))


_FOLD_SQL = f"""{_ORD_SQL}, b AS (SELECT date, CAST(floor((row_number() OVER (ORDER BY date) - 1) / 20) AS INT) AS fold FROM (SELECT DISTINCT date FROM long)), fi AS (SELECT factor, fold, ic FROM ics JOIN b USING (date)), g AS (SELECT DISTINCT factor, fold FROM long JOIN b USING (date)),
w AS (SELECT g.factor, g.fold, CASE WHEN sum(ic) >= 0 THEN 1.0 ELSE -1.0 END AS turn, CASE WHEN stddev_samp(ic) FILTER (fi.fold >= g.fold - 6) > 1e-12 THEN abs(avg(ic) FILTER (fi.fold >= g.fold - 6) / stddev_samp(ic) FILTER (fi.fold >= g.fold - 6)) * sqrt(252) ELSE 0 END AS weight FROM g JOIN fi ON fi.factor = g.factor AND fi.fold < g.fold WHERE g.fold >= 6 GROUP BY 1, 2)"""


@query(f"{_FOLD_SQL} SELECT factor, fold, turn, {_sqlr('weight')} FROM w")
def strategy_fold_weights(spark, sf_dir):
    long = _long(spark, sf_dir)
    return strategies.fold_weights(frozen.ordinal_ics(long), long.select("factor", "date")).select("factor", "fold", "turn", _r("weight"))


@query(f"""{_FOLD_SQL}, z AS (SELECT factor, date, code, (value - avg(value) OVER a) / (stddev_pop(value) OVER a + 1e-9) AS z FROM long WINDOW a AS (PARTITION BY factor, date)), t AS (SELECT fold, sum(weight) AS total, count(*) AS m FROM w GROUP BY 1),
s AS (SELECT date, code, fold, sum(z * turn * weight) AS x, sum(z * turn) AS e, count(z) AS n FROM z JOIN b USING (date) JOIN w USING (factor, fold) GROUP BY 1, 2, 3), c AS (SELECT date, code, CASE WHEN n = m THEN CASE WHEN total > 0 THEN x / total ELSE e / m END END AS signal FROM s JOIN t USING (fold)) SELECT date, code, {_sqlr('signal')} FROM c""")
def strategy_fold_signal(spark, sf_dir):
    long = _long(spark, sf_dir)
    weights = strategies.fold_weights(frozen.ordinal_ics(long), long.select("factor", "date"))
    return strategies.fold_signal(long, weights).select("date", "code", _r("signal"))


@query(f"""{_ORD_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS i FROM ics), k AS (SELECT factor, max(ic) AS peak, arg_max(date, ic) AS day FROM i WHERE i <= 252 GROUP BY 1)
SELECT factor, date_diff('day', any_value(day), min(date) FILTER (peak > 0 AND date >= day AND ic <= peak / 2)) AS days FROM i JOIN k USING (factor) WHERE i <= 252 GROUP BY 1""")
def strategy_half_life(spark, sf_dir):
    return strategies.half_life(frozen.ordinal_ics(_long(spark, sf_dir)))


@query(f"""WITH {BRAND_PANEL_SQL}, m AS (SELECT code, date, avg(close) OVER (PARTITION BY code ORDER BY date ROWS 4 PRECEDING) AS fast, avg(close) OVER (PARTITION BY code ORDER BY date ROWS 19 PRECEDING) AS slow FROM panel),
x AS (SELECT *, row_number() OVER w AS i, fast >= slow + 1e-6 AND lag(fast) OVER w < lag(slow) OVER w + 1e-6 AS rises FROM m WINDOW w AS (PARTITION BY code ORDER BY date)) SELECT code, date, i - coalesce(max(CASE WHEN rises THEN i END) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS bars_since_cross FROM x""")
def strategy_bars_since_cross(spark, sf_dir):
    from pyspark.sql import Window as W

    mean = lambda n: F.avg("close").over(W.partitionBy("code").orderBy("date").rowsBetween(1 - n, 0))
    p = brand_panel(spark, sf_dir).select("code", "date", mean(5).alias("fast"), (mean(20) + 1e-6).alias("slow"))
    return strategies.with_bars_since_cross(p, "fast", "slow").select("code", "date", "bars_since_cross")


@query(f"""WITH {BRAND_PANEL_SQL}, r AS (SELECT code, date, ln(nullif(close, 0) / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0)) / 100 AS r FROM panel), y AS (SELECT year(date) AS year, date, 0.7 * coalesce(max(r) FILTER (code = 'Brand#11'), 0) + 0.25 * coalesce(max(r) FILTER (code = 'Brand#12'), 0) + 0.05 * coalesce(max(r) FILTER (code = 'Brand#13'), 0) AS r FROM r GROUP BY date),
e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY year ORDER BY date)) AS e FROM y), f AS (SELECT *, e / greatest(1, max(e) OVER (PARTITION BY year ORDER BY date)) - 1 AS fall FROM e), g AS (SELECT year, exp(sum(ln(1 + r))) - 1 AS ret, stddev_samp(r) * sqrt(252) AS volatility, min(fall) AS max_fall, count(*) AS n FROM f GROUP BY 1) SELECT year, {_sqlr('ret', 'volatility', 'max_fall')}, n FROM g""")
def strategy_allocation(spark, sf_dir):
    from pyspark.sql import Window as W

    own = F.log(F.try_divide("close", F.lag("close").over(W.partitionBy("code").orderBy("date")))) / 100
    r = brand_panel(spark, sf_dir).select("code", "date", own.alias("r"))
    parts = {"Brand#11": 0.7, "Brand#12": 0.25, "Brand#13": 0.05}
    wide = r.groupBy("date").agg(*(F.max(F.when(F.col("code") == b, F.col("r"))).alias(f"w{i}") for i, b in enumerate(parts)))
    return strategies.allocation_by_year(wide, {f"w{i}": w for i, w in enumerate(parts.values())}).select("year", _r("ret"), _r("volatility"), _r("max_fall"), "n")


@query()
def strategy_trees(spark, sf_dir):
    p = _wide(spark, sf_dir)
    return strategies.walk_forward_trees(p, _NAMES, "label", research.year_folds(p), trees=20).select("date", "code", "fold", _r("prediction"))
