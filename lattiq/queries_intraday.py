"""Registered queries of minute-bar and daily-bar factors, candlesticks, channels and factor selection, with their SQL. Events stand for minute bars: a code per event type, a bar per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as X
from .functions.expr import NUDGE
from .operators import candles, correlations, evaluation, research
from .plans import intraday
from .plans.panel import BRAND_PANEL_SQL, brand_panel, table
from .queries import _BASE, _ICS, ORACLES, Compiler, _factor_query, _r, _sqlr, labelled, query

for _name, _exprs in {
    "signal_candlesticks": candles.patterns(), "signal_donchian": candles.donchian(), "signal_ichimoku": candles.ichimoku(), "signal_volatility_percentile": candles.volatility_percentile(), "indicator_running_prices": candles.running_prices(),
}.items():
    _factor_query(_name, _exprs)

_ORDER = ("ts", "event_id")


def minutes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_type").alias("code"), F.to_date("ts").alias("date"), "ts", "event_id", F.col("value").alias("open"), (F.col("value") + k % 5).alias("high"), (F.col("value") - k % 3 / 10).alias("low"), F.col("value").alias("close"),
        (k + 1).alias("volume"), (F.col("value") * (k + 1)).alias("amount"),
    )


_MINUTES = """minutes AS (SELECT event_type AS code, CAST(ts AS DATE) AS date, ts, event_id, value AS close, value + k % 5 AS high, value - k % 3 / 10 AS low, k + 1 AS volume, value * (k + 1) AS amount
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""

_DAILY_SQL = f"""{_MINUTES},
a AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY code, date) AS n, ln(nullif(close, 0) / nullif(lag(close) OVER w, 0)) AS r, volume - lag(volume) OVER w AS dv, (high - low) / nullif(close, 0) AS amp, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret5,
    (close / nullif(min(close) OVER u, 0) - 1 + max(close) OVER u / nullif(close, 0) - 1) / 2 AS pos, CASE WHEN count(*) OVER f = 5 THEN sum(volume) OVER f END AS sum5
  FROM minutes WINDOW w AS (PARTITION BY code, date ORDER BY ts, event_id), u AS (PARTITION BY code, date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY code, date ORDER BY ts, event_id ROWS 4 PRECEDING)),
b AS (SELECT *, CASE WHEN count(r) OVER f = 5 THEN stddev_pop(r) OVER f END AS v5, lag(sum5) OVER w AS sum5_before, avg(dv) OVER d AS mu, stddev_pop(dv) OVER d AS sd, CASE WHEN volume > 0 THEN abs(r) / sqrt(volume) END AS s, CASE WHEN r IS NOT NULL AND volume > 0 THEN volume END AS tv
  FROM a WINDOW w AS (PARTITION BY code, date ORDER BY i), f AS (PARTITION BY code, date ORDER BY i ROWS 4 PRECEDING), d AS (PARTITION BY code, date)),
c AS (SELECT *, CASE WHEN count(v5) OVER f = 5 THEN stddev_pop(v5) OVER f END AS amb FROM b WINDOW f AS (PARTITION BY code, date ORDER BY i ROWS 4 PRECEDING)),
rk AS (SELECT code, date, i, row_number() OVER (PARTITION BY code, date ORDER BY r NULLS LAST, i) AS kr, row_number() OVER (PARTITION BY code, date ORDER BY pos NULLS LAST, i) AS kp, sum(tv) OVER (PARTITION BY code, date ORDER BY s DESC NULLS LAST, i ROWS UNBOUNDED PRECEDING) AS cum, sum(tv) OVER (PARTITION BY code, date) AS traded FROM c WHERE i > 1),
e AS (SELECT c.*, kr, kp, cum, traded, avg(amb) OVER (PARTITION BY code, date) AS amb_mean, sum5 > sum5_before AND ret5 < 0 AND i >= 6 AND i <= n - 3 AS rapid, dv > mu + sd AS up, dv < mu - sd AS down, coalesce(volume > 2 * sum5 / 5, FALSE) AS spike FROM c LEFT JOIN rk USING (code, date, i)),
g AS (SELECT code, date, max(n) AS n, sum((2 * kr - n) * volume) AS g1, sum((2 * kp - n) * volume) AS g2, sum((2 * kr - n) * amp) AS g3, count(amb) AS na,
    covar_pop(amb, amount) AS cv, stddev_pop(amb) AS s1, stddev_pop(amount) FILTER (amb IS NOT NULL) AS s2,
    avg(amount) FILTER (amb > amb_mean) / (avg(amount) FILTER (amb IS NOT NULL) + 1e-10) AS ra, avg(volume) FILTER (amb > amb_mean) / (avg(volume) FILTER (amb IS NOT NULL) + 1e-10) AS rv,
    max(sd) AS sd, count(*) FILTER (up) AS nu, count(*) FILTER (down) AS nd, ln(nullif(arg_max(close, i), 0) / nullif(arg_min(close, i), 0)) AS dr, abs(avg(v5) FILTER (up) - avg(v5) FILTER (down)) AS bd, abs(avg(r) FILTER (up) - avg(r) FILTER (down)) AS sy,
    avg(2 * (exp(r) - 1 - r) - r * r) AS jump, count(*) FILTER (rapid) AS nr, sum(amount) FILTER (rapid) / nullif(sum(amount), 0) - sum(volume) FILTER (rapid) / nullif(sum(volume), 0) AS fl, count(s) AS ns,
    sum(close * tv) FILTER (cum - tv < 0.2 * traded) / nullif(sum(tv) FILTER (cum - tv < 0.2 * traded), 0) / nullif(sum(close * tv) / nullif(sum(tv), 0), 0) AS q,
    avg(amp) FILTER (spike) AS sp, avg(amp) FILTER (NOT spike) AS ca FROM e GROUP BY ALL),
h AS (SELECT code, date, CASE WHEN count(*) FILTER (v > 0) >= 10 THEN -sum(v / t * log2(v / t)) END AS entropy FROM (SELECT *, sum(v) OVER (PARTITION BY code, date) AS t FROM (SELECT code, date, least(47, (i - 1) // (n // 48)) AS b, sum(volume) AS v FROM a WHERE n >= 48 GROUP BY ALL)) GROUP BY ALL),
daily AS (SELECT code, date, CASE WHEN n > 20 THEN g1 END AS game_ret, CASE WHEN n > 20 THEN g2 END AS game_pos, CASE WHEN n > 20 THEN g3 END AS game_amp,
    CASE WHEN n >= 30 AND na >= 15 THEN CASE WHEN s1 > 1e-13 AND s2 > 1e-13 THEN cv / (s1 * s2) ELSE 0 END END AS cloud_corr, CASE WHEN n >= 30 AND na >= 15 THEN coalesce(ra, 0) END AS cloud_amount,
    CASE WHEN n >= 30 AND na >= 15 THEN coalesce(ra, 0) - coalesce(rv, 0) END AS cloud_spread,
    CASE WHEN n >= 30 AND sd >= 1e-10 THEN CASE WHEN nu >= 2 AND nd >= 2 THEN dr * coalesce(bd, 0) ELSE 0 END END AS treat_vol, CASE WHEN n >= 30 AND sd >= 1e-10 THEN CASE WHEN nu >= 2 AND nd >= 2 THEN dr * sy ELSE 0 END END AS treat_ret,
    CASE WHEN n >= 30 THEN jump END AS jump, CASE WHEN n >= 20 THEN CASE WHEN nr >= 3 THEN fl ELSE 0 END END AS rapids, CASE WHEN n >= 20 AND ns >= 15 THEN q END AS smart_money,
    CASE WHEN n >= 20 AND ca >= 1e-10 THEN 1 - coalesce(sp, 0) / ca END AS elasticity, entropy FROM g LEFT JOIN h USING (code, date))"""
_DAILY = ("game_ret", "game_pos", "game_amp", "cloud_corr", "cloud_amount", "cloud_spread", "treat_vol", "treat_ret", "jump", "rapids", "smart_money", "elasticity", "entropy")


@query(f"WITH {_DAILY_SQL} SELECT code, date, {_sqlr(*_DAILY, digits=5)} FROM daily")
def intraday_daily_factors(spark, sf_dir):
    return intraday.daily_factors(minutes(spark, sf_dir), _ORDER).select("code", "date", *(_r(c, 5) for c in _DAILY))


@query(f"""WITH {_DAILY_SQL}, x AS (SELECT code, date, CASE WHEN count(smart_money) OVER w >= 5 THEN (avg(smart_money) OVER w + stddev_samp(smart_money) OVER w) / 2 END AS blended FROM daily WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
y AS (SELECT *, count(blended) OVER d AS k, avg(blended) OVER d AS m, stddev_pop(blended) OVER d AS s FROM x WINDOW d AS (PARTITION BY date))
SELECT code, date, {_sqlr('blended')}, round(CASE WHEN k >= 5 AND s >= 1e-10 THEN abs((blended - m) / s) END + {NUDGE}, 5) AS distance FROM y""")
def intraday_blend(spark, sf_dir):
    return intraday.blend(intraday.daily_factors(minutes(spark, sf_dir), _ORDER), "smart_money").select("code", "date", _r("blended"), _r("distance", 5))


@query(f"""WITH {_MINUTES}, f AS (SELECT code, date, (close - lag(close) OVER (PARTITION BY code ORDER BY date, ts, event_id)) * volume AS f FROM minutes), d AS (SELECT code, date, sum(f) AS flow FROM f GROUP BY ALL)
SELECT code, date, round(flow + {NUDGE}, 4) AS flow, round(CASE WHEN count(flow) OVER w >= 5 THEN avg(flow) OVER w END + {NUDGE}, 4) AS money_flow FROM d WINDOW w AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)""")
def intraday_money_flow(spark, sf_dir):
    return intraday.money_flow(minutes(spark, sf_dir), _ORDER).select("code", "date", _r("flow", 4), _r("money_flow", 4))


_BARS = ("coin_team", "overnight", "divergence", "amihud", "downside", "percentile", "idio_vol", "reversal_equal", "reversal_volume")


@query(f"""WITH {BRAND_PANEL_SQL},
a AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS inter, close / nullif(open, 0) - 1 AS intra, open / nullif(lag(close) OVER w, 0) - 1 AS night, ln(nullif(close, 0) / nullif(lag(close) OVER w, 0)) AS logr, CASE WHEN count(*) OVER t >= 5 THEN volume / nullif(avg(volume) OVER t, 0) END AS turn
  FROM panel WINDOW w AS (PARTITION BY code ORDER BY date), t AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
b AS (SELECT *, avg(inter) OVER (PARTITION BY date) AS market, turn - lag(turn) OVER (PARTITION BY code ORDER BY date) AS tc, CASE WHEN count(inter) OVER t >= 5 THEN stddev_samp(inter) OVER t END AS si, CASE WHEN count(intra) OVER t >= 5 THEN stddev_samp(intra) OVER t END AS sa,
    CASE WHEN count(night) OVER t >= 5 THEN stddev_samp(night) OVER t END AS sn FROM a WINDOW t AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING)),
c AS (SELECT *, CASE WHEN si < CASE WHEN count(si) OVER l >= 20 THEN avg(si) OVER l END THEN -1 ELSE 1 END AS fi, CASE WHEN tc < CASE WHEN count(tc) OVER l >= 20 THEN avg(tc) OVER l END THEN -1 ELSE 1 END AS ft,
    CASE WHEN sa < CASE WHEN count(sa) OVER l >= 20 THEN avg(sa) OVER l END THEN -1 ELSE 1 END AS fa, CASE WHEN sn < CASE WHEN count(sn) OVER l >= 20 THEN avg(sn) OVER l END THEN -1 ELSE 1 END AS fn,
    1 + abs(night - CASE WHEN count(night) OVER l >= 20 THEN avg(night) OVER l END) AS far, covar_pop(inter, market) OVER p AS cm, var_pop(market) FILTER (inter IS NOT NULL) OVER p AS vm, var_pop(inter) OVER p AS vi, count(inter) OVER p AS np
  FROM b WINDOW l AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING), p AS (PARTITION BY code ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
d AS (SELECT code, date, ((CASE WHEN count(inter) OVER t >= 5 THEN sum(inter) OVER t END) * (fi + ft) / 2 + (CASE WHEN count(intra) OVER t >= 5 THEN sum(intra) OVER t END) * fa + (CASE WHEN count(night) OVER t >= 5 THEN sum(night) OVER t END) * fn * far) / 3 AS coin_team,
    CASE WHEN count(night) OVER t >= 20 THEN avg(night) OVER t END AS overnight, CASE WHEN count(*) OVER t = 20 AND stddev_samp(close) OVER t > 1e-13 AND stddev_samp(volume) OVER t > 1e-13 THEN covar_samp(close, volume) OVER t / (stddev_samp(close) OVER t * stddev_samp(volume) OVER t) END AS divergence,
    CASE WHEN count(inter) OVER t = 20 THEN avg(abs(inter) / nullif(volume, 0)) OVER t END AS amihud, CASE WHEN count(inter) OVER t >= 10 THEN sqrt(avg(CASE WHEN inter IS NOT NULL THEN pow(least(inter, 0), 2) END) OVER t) END AS downside,
    CASE WHEN count(close) OVER q >= 20 THEN len(list_filter(list(close) OVER q, lambda x: x < close)) / count(close) OVER q END AS percentile,
    CASE WHEN np = 20 THEN sqrt(greatest(vi + pow(cm / CASE WHEN vm > 1e-18 THEN vm END, 2) * vm - 2 * cm / CASE WHEN vm > 1e-18 THEN vm END * cm, 0)) END AS idio_vol,
    CASE WHEN count(logr) OVER t = 20 THEN avg(logr) OVER t END AS reversal_equal, CASE WHEN count(logr) OVER t = 20 THEN sum(logr * volume) OVER t / nullif(sum(CASE WHEN logr IS NOT NULL THEN volume END) OVER t, 0) END AS reversal_volume
  FROM c WINDOW t AS (PARTITION BY code ORDER BY date ROWS 19 PRECEDING), q AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING))
SELECT code, date, {_sqlr(*_BARS)} FROM d""")
def daily_bar_factors(spark, sf_dir):
    return intraday.bar_factors(brand_panel(spark, sf_dir)).select("code", "date", *(_r(c) for c in _BARS))


# ------------------------------------------------------------------------------------------------------ life cycle, selection

_STATES = _BASE + _ICS + """,
w AS (SELECT date, count(ic) OVER x AS c, avg(ic) OVER x AS m, stddev_samp(ic) OVER x AS s, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) OVER x AS p FROM ic WINDOW x AS (ORDER BY date ROWS 59 PRECEDING)),
v AS (SELECT date, CASE WHEN c >= 20 THEN m END AS roll_mean, CASE WHEN c >= 20 THEN m / nullif(s, 0) END AS roll_ir, CASE WHEN c >= 20 THEN p END AS positive_share FROM w),
z AS (SELECT *, CASE WHEN roll_mean IS NULL THEN 'warming' WHEN abs(roll_mean) >= 0.015 AND abs(roll_ir) >= 0.2 AND positive_share >= 0.45 THEN 'alive' WHEN count(*) FILTER (abs(roll_mean) >= 0.015) OVER (ORDER BY date ROWS 19 PRECEDING) > 0 THEN 'decaying' ELSE 'dead' END AS state FROM v)
"""


@query(_STATES + f"SELECT date, {_sqlr('roll_mean', 'roll_ir', 'positive_share')}, state FROM z")
def eval_rolling_lifecycle(spark, sf_dir):
    s = evaluation.rolling_lifecycle(evaluation.daily_ic(labelled(spark, sf_dir), "factor", "label"))
    return s.select("date", _r("roll_mean"), _r("roll_ir"), _r("positive_share"), "state")


@query(_STATES.rstrip() + f""", l AS (SELECT * FROM z ORDER BY date DESC LIMIT 1), k AS (SELECT min(date) AS since FROM z WHERE date > coalesce((SELECT max(date) FROM z WHERE state != 'alive'), DATE '0001-01-01')),
q AS (SELECT date, roll_ir FROM z WHERE roll_ir IS NOT NULL ORDER BY roll_ir DESC, date LIMIT 1)
SELECT l.state AS status, CASE WHEN l.state = 'alive' THEN since END AS alive_since, CAST(CASE WHEN l.state = 'alive' THEN l.date - since END AS INT) AS alive_days, {_sqlr('roll_mean', 'positive_share')}, round(l.roll_ir + {NUDGE}, 6) AS roll_ir, round(q.roll_ir + {NUDGE}, 6) AS peak_ir, q.date AS peak_date FROM l, k, q""")
def eval_lifecycle(spark, sf_dir):
    s = evaluation.lifecycle(evaluation.rolling_lifecycle(evaluation.daily_ic(labelled(spark, sf_dir), "factor", "label")))
    return s.select("status", "alive_since", "alive_days", _r("roll_mean"), _r("positive_share"), _r("roll_ir"), _r("peak_ir"), "peak_date")


def _pair_sql() -> str:
    """Mean daily rank correlation of each pair of the factors that eval_factor_correlation compares."""
    from .queries import _PAIR

    names = list(_PAIR)
    base = Compiler(_PAIR).to_sql(BRAND_PANEL_SQL, digits=None)
    ranked = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {n}) + (count(*) OVER (PARTITION BY date, {n}) - 1) / 2.0) / count({n}) OVER (PARTITION BY date) END AS {n}" for n in names)
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, avg(c) AS corr, count(c) AS n_days FROM (SELECT date, CASE WHEN stddev_samp({x}) > 1e-13 AND stddev_samp({y}) > 1e-13 THEN covar_samp({a}, {b}) / (stddev_samp({x}) * stddev_samp({y})) END AS c FROM ranked GROUP BY date) HAVING count(c) > 0")
    return f"WITH f0 AS ({base}), ranked AS (SELECT date, {ranked} FROM f0), u AS ({' UNION ALL '.join(parts)}) "


ORACLES["eval_factor_correlation"] = _pair_sql() + f"SELECT a, b, round(corr + {NUDGE}, 6) AS corr, n_days FROM u"


@query(_pair_sql() + f"SELECT a, b, round(corr + {NUDGE}, 6) AS corr FROM u WHERE abs(corr) >= 0.1")
def eval_correlated_pairs(spark, sf_dir):
    from .queries import _PAIR

    found = correlations.factor_correlation(Compiler(_PAIR).apply(brand_panel(spark, sf_dir)), list(_PAIR))
    return evaluation.correlated_pairs(found, 0.1).select("a", "b", _r("corr"))


# ------------------------------------------------------------------------------------------------------------------ research


@query("""WITH e AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders), k AS (SELECT unnest(range(0, 50)) AS fold),
f AS (SELECT CAST(fold AS INT) AS fold, CAST(a + to_years(CAST(fold AS INT)) AS DATE) AS train_from, CAST(a + to_years(CAST(fold AS INT) + 3) AS DATE) AS test_from, CAST(a + to_years(CAST(fold AS INT) + 4) AS DATE) AS test_to, b FROM e, k)
SELECT fold, train_from, test_from, test_to FROM f WHERE test_to <= b""")
def research_year_folds(spark, sf_dir):
    return research.year_folds(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")))


_GRID = research.grid()
_LABEL = {"label": X.lead(X.col("close"), 2) / X.lead(X.col("close"), 1) - 1}


def _grid_sql() -> str:
    rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x}) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    base = Compiler(_GRID | _LABEL).to_sql(BRAND_PANEL_SQL, digits=None)
    near = lambda n: f"CASE WHEN label IS NOT NULL THEN {n} END AS {n}"
    part = lambda n: f"SELECT '{n}' AS factor, avg(c) AS ic_mean, stddev_samp(c) AS s, count(c) AS n_days FROM (SELECT date, CASE WHEN stddev_samp({n}) > 1e-13 AND stddev_samp(CASE WHEN {n} IS NOT NULL THEN y END) > 1e-13 THEN covar_samp({n}, y) / (stddev_samp({n}) * stddev_samp(CASE WHEN {n} IS NOT NULL THEN y END)) END AS c FROM r GROUP BY date) HAVING count(c) > 0"
    return f"WITH f0 AS ({base}), f AS (SELECT date, label, {', '.join(near(n) for n in _GRID)} FROM f0), r AS (SELECT date, {rank('label')} AS y, {', '.join(f'{rank(n)} AS {n}' for n in _GRID)} FROM f), u AS ({' UNION ALL '.join(part(n) for n in _GRID)}) SELECT factor, round(ic_mean + {NUDGE}, 4) AS ic_mean, round(ic_mean / nullif(s, 0) + {NUDGE}, 4) AS icir, n_days FROM u"


@query(_grid_sql())
def research_grid(spark, sf_dir):
    f = Compiler(_GRID | _LABEL).apply(brand_panel(spark, sf_dir))
    return research.grid_scores(f, list(_GRID), "label").select("factor", _r("ic_mean", 4), _r("icir", 4), "n_days")


_TWO = {"a": X.col("close") / X.delay(X.col("close"), 5) - 1, "b": X.rank(X.col("volume"))} | _LABEL


@query(f"""WITH f AS ({Compiler(_TWO).to_sql(BRAND_PANEL_SQL, digits=None)}), g AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL),
d AS (SELECT date, count(label) AS n, coalesce(sum(a) FILTER (label IS NOT NULL), 0) AS sa, coalesce(sum(b) FILTER (label IS NOT NULL), 0) AS sb, coalesce(sum(label), 0) AS sy, coalesce(sum(a * a) FILTER (label IS NOT NULL), 0) AS saa,
  coalesce(sum(b * b) FILTER (label IS NOT NULL), 0) AS sbb, coalesce(sum(a * b) FILTER (label IS NOT NULL), 0) AS sab, coalesce(sum(a * label), 0) AS say, coalesce(sum(b * label), 0) AS sby FROM g GROUP BY date),
w AS (SELECT date, row_number() OVER (ORDER BY date) AS i, sum(n) OVER p AS n, sum(sa) OVER p AS sa, sum(sb) OVER p AS sb, sum(sy) OVER p AS sy, sum(saa) OVER p AS saa, sum(sbb) OVER p AS sbb, sum(sab) OVER p AS sab, sum(say) OVER p AS say, sum(sby) OVER p AS sby
  FROM d WINDOW p AS (ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, sa / n AS ma, sb / n AS mb, sy / n AS my, sqrt(greatest(saa / n - (sa / n) * (sa / n), 0)) + 1e-9 AS da, sqrt(greatest(sbb / n - (sb / n) * (sb / n), 0)) + 1e-9 AS db FROM w WHERE i > 252 AND n >= 50),
c AS (SELECT *, (saa - n * ma * ma) / (da * da) + 1 AS p, (sbb - n * mb * mb) / (db * db) + 1 AS q, (sab - n * ma * mb) / (da * db) AS r, (say - n * ma * my) / da AS u, (sby - n * mb * my) / db AS v FROM m),
k AS (SELECT date, ma, mb, da, db, (q * u - r * v) / (p * q - r * r) AS wa, (p * v - r * u) / (p * q - r * r) AS wb FROM c)
SELECT g.date, code, round(coalesce(wa * (a - ma) / da + wb * (b - mb) / db, 0) + {NUDGE}, 5) AS stacked FROM g LEFT JOIN k ON g.date = k.date""")
def research_stacked_ridge(spark, sf_dir):
    f = Compiler(_TWO).apply(brand_panel(spark, sf_dir))
    return research.stacked_ridge(f, "a", "b", "label").select("date", "code", _r("stacked", 5))


@query(f"""WITH x AS (SELECT value - 90 AS y FROM events WHERE value > 90), s AS (SELECT count(*) AS n, avg(y) AS m, avg(y * y) AS v FROM x)
SELECT n, round(CASE WHEN n >= 10 THEN (1 - m * m / v) / 2 END + {NUDGE}, 6) AS shape, round(CASE WHEN n >= 10 THEN m * (1 + m * m / v) / 2 END + {NUDGE}, 6) AS scale FROM s""")
def research_gpd_fit(spark, sf_dir):
    return research.gpd_fit(table(spark, sf_dir, "events"), "value", 90.0).select("n", _r("shape"), _r("scale"))


@query(f"""WITH {_MINUTES}, t AS (SELECT *, code IN ('purchase', 'signup') AS buys, close - lag(close) OVER w AS st, lag(volume) OVER w AS before, (close - min(close) OVER d) / (max(close) OVER d - min(close) OVER d + 1e-12) AS p, (volume - min(volume) OVER d) / (max(volume) OVER d - min(volume) OVER d + 1e-12) AS v
  FROM minutes WINDOW w AS (PARTITION BY date ORDER BY ts, event_id), d AS (PARTITION BY date)),
m AS (SELECT *, CASE WHEN abs(st) > 1e-9 AND volume > 0 THEN ln(volume) END AS x, CASE WHEN abs(st) > 1e-9 AND volume > 0 THEN ln(abs(st) + 1e-12) END AS y FROM t)
SELECT date, count(*) AS n, round(coalesce(corr(CASE WHEN before IS NOT NULL THEN volume END, before), 0) + {NUDGE}, 6) AS volume_autocorr, round(CASE WHEN count(x) > 5 THEN regr_intercept(y, x) ELSE 0 END + {NUDGE}, 6) AS impact_intercept,
  round(sqrt(sum((p - v) * (p - v))) / count(*) + {NUDGE}, 6) AS path_distance, round(quantile_cont(abs(st), 0.5) + {NUDGE}, 6) AS median_step, round(coalesce(coalesce(sum(volume) FILTER (buys), 0) / nullif(sum(volume), 0), 0) + {NUDGE}, 6) AS buy_share FROM m GROUP BY date HAVING count(*) >= 10""")
def research_tick_structure(spark, sf_dir):
    t = minutes(spark, sf_dir).withColumn("side", F.when(F.col("code").isin("purchase", "signup"), 1).otherwise(-1))
    s = research.tick_structure(t, ["date"], _ORDER, "close", "volume", "side")
    return s.select("date", "n", *(_r(c) for c in s.columns[2:]))


# ---------------------------------------------------------------------------------------------- SQL of queries in other modules

ORACLES["text_search"] = f"""WITH w AS (SELECT row_number() OVER () AS r, concat_ws(':', conv_id, turn) AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+|[一-鿿]') AS w FROM conversations), q AS (SELECT unnest(['attention', 'the', 'thing']) AS t),
d AS (SELECT r, id, len(w) AS l, t, len(list_filter(w, lambda x: x = t)) AS tf FROM w, q), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w), i AS (SELECT t, count(*) FILTER (tf > 0) AS df FROM d GROUP BY t),
s AS (SELECT id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM d JOIN i USING (t), n GROUP BY r, id)
SELECT id, round(score + {NUDGE}, 6) AS score FROM s WHERE score > 0"""


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


ORACLES["option_prices"] = f"""WITH p AS (SELECT p_partkey AS id, p_retailprice AS s, p_retailprice * (0.8 + p_size / 125) AS k, p_size / 365 AS t, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END AS g FROM part),
v AS (SELECT *, greatest(0.01, 0.25 - 0.15 * ln(k / s) + 0.05 * ln(k / s) * ln(k / s)) AS v, k * exp(-0.03 * t) AS dk FROM p), r AS (SELECT *, v * sqrt(t) AS root, (ln(s / k) + (0.03 + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM v),
n AS (SELECT *, g * d1 AS x1, g * (d1 - root) AS x2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS f FROM r), c AS (SELECT *, {_cdf('x1')} AS n1, {_cdf('x2')} AS n2 FROM n)
SELECT id, {', '.join(f'round({e} + {NUDGE}, 6) AS {n}' for n, e in {'price': 'g * (s * n1 - dk * n2)', 'delta': 'g * n1', 'gamma': 'f / (s * root)', 'theta': '(-s * f * v / (2 * sqrt(t)) - g * 0.03 * dk * n2) / 365', 'vega': 's * f * sqrt(t) / 100'}.items())} FROM c"""


@query(f"""WITH RECURSIVE {_MINUTES}, m AS (SELECT code, date, volume, row_number() OVER w AS i, count(*) OVER (PARTITION BY code, date) AS n, coalesce(sum(volume) OVER (PARTITION BY code, date ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) AS later FROM minutes WINDOW w AS (PARTITION BY code, date ORDER BY ts, event_id)),
top AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY code, date ORDER BY volume DESC, i) <= 10), hop AS (SELECT a.code, a.date, a.i, min(b.i) AS then FROM top a LEFT JOIN top b ON a.code = b.code AND a.date = b.date AND b.i > a.i + 5 GROUP BY 1, 2, 3),
taken AS (SELECT code, date, min(i) AS i FROM top GROUP BY 1, 2 UNION ALL SELECT h.code, h.date, h.then FROM taken k JOIN hop h ON h.code = k.code AND h.date = k.date AND h.i = k.i WHERE h.then IS NOT NULL),
f AS (SELECT code, date, avg(later / nullif(volume, 0)) AS follow, count(*) AS peaks FROM taken JOIN top USING (code, date, i) GROUP BY 1, 2), d AS (SELECT code, date, max(n) AS n FROM m GROUP BY 1, 2), r AS (SELECT code, date, CASE WHEN n >= 30 AND peaks >= 2 THEN follow END AS follow FROM d LEFT JOIN f USING (code, date)) SELECT code, date, {_sqlr('follow')} FROM r""")
def intraday_followed_peaks(spark, sf_dir):
    return intraday.followed_peaks(minutes(spark, sf_dir), _ORDER).select("code", "date", _r("follow"))


@query()
def intraday_day_shapes(spark, sf_dir):
    return intraday.day_shapes(minutes(spark, sf_dir), _ORDER).select("code", "date", *(_r(c, 4) for c in ("ripple", "lag_spread", "level_size", "level")))
