"""Registered queries of rolling correlations, batch life cycles, periodic selection and blends by market state, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as X
from .functions.expr import NUDGE
from .operators import blends, correlations, selection, signals
from .plans.panel import BRAND_PANEL_SQL, brand_panel, table
from .queries import _PAIR, Compiler, _r, _sqlr, query

_BRANDS = sorted(f"Brand#{k}" for k in range(1, 26))
_MONTH_ENDS = "ends AS (SELECT max(date) AS date FROM days GROUP BY date_trunc('month', date))"


def month_ends(df):
    """The last date of each month that df has."""
    return df.groupBy(F.date_trunc("month", "date").alias("_m")).agg(F.max("date").alias("date")).select("date")


def returns(spark, sf_dir):
    from pyspark.sql import Window as W

    p = brand_panel(spark, sf_dir)
    return p.select("date", "code", (F.try_divide("close", F.lag("close").over(W.partitionBy("code").orderBy("date"))) - 1).alias("ret"))


_RETURNS = f"{BRAND_PANEL_SQL}, r AS (SELECT date, code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel)"
_SUMS = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy"


def _windowed(moments: str, window: int) -> str:
    """SQL of windows of `window` days over moments (date, a, b, n, sx, ...), of days (date): full windows with a correlation."""
    sums = ", ".join(f"sum({c}) OVER w AS {c}" for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    return f"""{moments}, pairs AS (SELECT DISTINCT a, b FROM moments), grid AS (SELECT t.date, t.t, a, b, coalesce(n, 0) AS n, coalesce(sx, 0) AS sx, coalesce(sy, 0) AS sy, coalesce(sxx, 0) AS sxx, coalesce(syy, 0) AS syy, coalesce(sxy, 0) AS sxy
  FROM (SELECT date, row_number() OVER (ORDER BY date) AS t FROM days) t CROSS JOIN pairs LEFT JOIN moments USING (date, a, b)),
win AS (SELECT date, t, a, b, {sums} FROM grid WINDOW w AS (PARTITION BY a, b ORDER BY t ROWS {window - 1} PRECEDING)),
var AS (SELECT *, (sxx - sx * sx / n) / (n - 1) AS vx, (syy - sy * sy / n) / (n - 1) AS vy, (sxy - sx * sy / n) / (n - 1) AS c FROM win WHERE t >= {window} AND n >= 5)
SELECT date, a, b, CAST(n AS BIGINT) AS n, round(c / (sqrt(vx) * sqrt(vy)) + {NUDGE}, 5) AS corr FROM var"""


def _factor_pairs(exprs=_PAIR, prefix="WITH ") -> str:
    """Moments of each date's raw ranks of the factors, pair by pair."""
    names = list(exprs)
    rank = lambda n: f"CASE WHEN {n} IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY {n}) + (count(*) OVER (PARTITION BY date, {n}) - 1) / 2.0 END AS {n}"
    parts = [f"SELECT date, '{a}' AS a, '{b}' AS b, {a} AS x, {b} AS y FROM ranked WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(names) for b in names[i + 1 :]]
    base = Compiler(exprs).to_sql(BRAND_PANEL_SQL, digits=None)
    return f"{prefix}f0 AS ({base}), days AS (SELECT DISTINCT date FROM f0), ranked AS (SELECT date, {', '.join(map(rank, names))} FROM f0), moments AS (SELECT date, a, b, {_SUMS} FROM ({' UNION ALL '.join(parts)}) GROUP BY date, a, b)"


@query(_windowed(_factor_pairs(), 60) + " WHERE vx > 1e-26 AND vy > 1e-26")
def eval_rolling_factor_correlation(spark, sf_dir):
    f = Compiler(_PAIR).apply(brand_panel(spark, sf_dir))
    return correlations.rolling_factor_correlation(f, list(_PAIR), 60).select("date", "a", "b", "n", _r("corr", 5))


_CODE_MOMENTS = f"WITH {_RETURNS}, q AS (SELECT * FROM r WHERE ret IS NOT NULL), days AS (SELECT DISTINCT date FROM q), {_MONTH_ENDS}, moments AS (SELECT date, a, b, {_SUMS} FROM (SELECT p.date, p.code AS a, q.code AS b, p.ret AS x, q.ret AS y FROM q AS p JOIN q ON p.date = q.date AND p.code < q.code) GROUP BY date, a, b)"


@query(_windowed(_CODE_MOMENTS, 60) + " WHERE vx > 1e-26 AND vy > 1e-26 AND date IN (SELECT date FROM ends)")
def eval_rolling_code_correlation(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    return correlations.rolling_code_correlation(r, "ret", _BRANDS, 60, month_ends(r)).select("date", "a", "b", "n", _r("corr", 5))


_EVENT_CODES = ["click", "error", "purchase", "signup", "view"]


def _event_returns(spark, sf_dir):
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("code")).agg(F.avg("value").alias("close"))
    return e.select("date", "code", (F.try_divide("close", F.lag("close").over(W.partitionBy("code").orderBy("date"))) - 1).alias("ret"))


@query(f"""WITH e AS (SELECT CAST(ts AS DATE) AS date, event_type AS code, avg(value) AS close FROM events GROUP BY ALL), r AS (SELECT date, code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM e),
k AS (SELECT date FROM r WHERE ret IS NOT NULL GROUP BY date HAVING count(*) = 5 ORDER BY date DESC LIMIT 20), q AS (SELECT code, date, rank() OVER (PARTITION BY code ORDER BY ret) AS ret FROM r WHERE date IN (SELECT date FROM k))
SELECT p.code AS a, q.code AS b, round(coalesce(corr(p.ret, q.ret), 0) + {NUDGE}, 6) AS corr, count(*) AS n FROM q AS p JOIN q ON p.date = q.date AND p.code < q.code GROUP BY p.code, q.code""")
def eval_code_correlation_matrix(spark, sf_dir):
    return correlations.correlation_matrix(_event_returns(spark, sf_dir), "ret", _EVENT_CODES, 20, True).select("a", "b", _r("corr"), "n")


# ------------------------------------------------------------------------------------------------- life cycles and selection

_C, _V = X.col("close"), X.col("volume")
_SIX = _PAIR | {"rev3": 1 - _C / X.delay(_C, 3), "volume_jump": _V / X.ts_mean(_V, 5), "width": (X.col("high") - X.col("low")) / _C}
_THEMES = {"mom5": ["momentum"], "size": ["value", "liquidity"], "low_vol": ["volatility"], "rev3": ["reversal"], "volume_jump": ["volume", "momentum"], "width": ["volatility"]}
_WITH_LABEL = _SIX | {"label": X.lead(_C, 2) / X.lead(_C, 1) - 1}
_SIX_ICS = f"""WITH f1 AS ({Compiler(_WITH_LABEL).to_sql(BRAND_PANEL_SQL, digits=None)}), long AS (UNPIVOT (SELECT date, code, label, {', '.join(_SIX)} FROM f1 WHERE label IS NOT NULL) ON {', '.join(_SIX)} INTO NAME factor VALUE v),
lr AS (SELECT date, factor, rank() OVER (PARTITION BY date, factor ORDER BY v) + (count(*) OVER (PARTITION BY date, factor, v) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date, factor ORDER BY label) + (count(*) OVER (PARTITION BY date, factor, label) - 1) / 2.0 AS y FROM long),
ic AS (SELECT date, factor, covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS ic, count(*) AS n FROM lr GROUP BY ALL HAVING count(*) >= 5 AND stddev_samp(x) > 1e-13 AND stddev_samp(y) > 1e-13)"""
_SIX_STATES = _SIX_ICS + """,
w AS (SELECT date, factor, count(ic) OVER x AS c, avg(ic) OVER x AS m, stddev_samp(ic) OVER x AS s, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) OVER x AS p FROM ic WINDOW x AS (PARTITION BY factor ORDER BY date ROWS 59 PRECEDING)),
v AS (SELECT date, factor, CASE WHEN c >= 20 THEN m END AS roll_mean, CASE WHEN c >= 20 THEN m / nullif(s, 0) END AS roll_ir, CASE WHEN c >= 20 THEN p END AS positive_share FROM w),
z AS (SELECT *, CASE WHEN roll_mean IS NULL THEN 'warming' WHEN abs(roll_mean) >= 0.015 AND abs(roll_ir) >= 0.2 AND positive_share >= 0.45 THEN 'alive' WHEN count(*) FILTER (abs(roll_mean) >= 0.015) OVER (PARTITION BY factor ORDER BY date ROWS 19 PRECEDING) > 0 THEN 'decaying' ELSE 'dead' END AS state FROM v)"""


def six(spark, sf_dir):
    return Compiler(_WITH_LABEL).apply(brand_panel(spark, sf_dir))


def six_states(f):
    return selection.rolling_lifecycles(selection.daily_ics(f, list(_SIX), "label"))


@query(_SIX_ICS + f" SELECT date, factor, {_sqlr('ic')}, n FROM ic")
def eval_batch_ics(spark, sf_dir):
    return selection.daily_ics(six(spark, sf_dir), list(_SIX), "label").select("date", "factor", _r("ic"), "n")


@query(_SIX_STATES + f""", b AS (SELECT factor, max(date) FILTER (state != 'alive') AS broken FROM z GROUP BY factor), l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY factor ORDER BY date DESC) = 1),
since AS (SELECT factor, min(date) AS since FROM z JOIN b USING (factor) WHERE broken IS NULL OR date > broken GROUP BY factor), k AS (SELECT factor, roll_ir AS peak_ir, date AS peak_date FROM z WHERE roll_ir IS NOT NULL QUALIFY row_number() OVER (PARTITION BY factor ORDER BY roll_ir DESC, date) = 1)
SELECT l.factor, state AS status, CASE WHEN state = 'alive' THEN since END AS alive_since, {_sqlr('roll_mean', 'roll_ir', 'positive_share', 'peak_ir')}, peak_date FROM l LEFT JOIN since USING (factor) LEFT JOIN k USING (factor)""")
def eval_batch_lifecycle(spark, sf_dir):
    s = selection.lifecycles(six_states(six(spark, sf_dir)))
    return s.select("factor", "status", "alive_since", *(_r(c) for c in ("roll_mean", "roll_ir", "positive_share", "peak_ir")), "peak_date")


_CHAINS_SQL = ", ".join(f"({k}, '{name}', {of})" for k, (name, of) in enumerate(selection.CHAINS.items()))


def _selection_sql(wait: int = 2, per_theme: int = 2, least_ir: float = 0.3, limit: float = 0.2, most: int = 4) -> str:
    themes = ", ".join(f"('{f}', {of})" for f, of in _THEMES.items())
    corr = _windowed(_factor_pairs(_SIX, _SIX_STATES + ", "), 60).replace("SELECT date, a, b, CAST(n AS BIGINT) AS n, round(", ", co AS (SELECT date, a, b, (", 1).replace(f" + {NUDGE}, 5) AS corr FROM var", ") AS corr FROM var WHERE vx > 1e-26 AND vy > 1e-26 AND date IN (SELECT max(date) FROM days GROUP BY date_trunc('month', date)))", 1)
    return f"""{corr.replace("WITH ", "WITH RECURSIVE ", 1)},
ends AS (SELECT max(date) AS period FROM days GROUP BY date_trunc('month', date)), kn AS (SELECT *, lead(date, {wait}) OVER (PARTITION BY factor ORDER BY date) AS known FROM z), kx AS (SELECT *, lead(known) OVER (PARTITION BY factor ORDER BY date) AS nxt FROM kn WHERE known IS NOT NULL),
ats AS (SELECT period, kx.* FROM kx JOIN ends ON period >= known AND (nxt IS NULL OR period < nxt)), cnt AS (SELECT period, count(*) FILTER (state = 'alive') AS n_alive, count(*) FILTER (state = 'decaying') AS n_decaying, count(*) FILTER (state = 'dead') AS n_dead FROM ats GROUP BY period),
th(factor, themes) AS (VALUES {themes}), al AS (SELECT period, factor, abs(roll_ir) AS ir, abs(roll_mean) AS ic, unnest(themes) AS theme FROM ats JOIN th USING (factor) WHERE state = 'alive' AND abs(roll_ir) >= {least_ir}),
pk AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY period, theme ORDER BY ir DESC, factor) <= {per_theme}), cov AS (SELECT period, list_sort(list(DISTINCT theme)) AS themes FROM pk GROUP BY period),
ch AS (SELECT DISTINCT period, factor, ir, ic FROM pk), tr AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY period ORDER BY ir DESC, factor) <= {most}),
bo AS (SELECT a AS factor, b AS other, date, corr FROM co UNION ALL SELECT b, a, date, corr FROM co), sp AS (SELECT *, lead(date) OVER (PARTITION BY factor, other ORDER BY date) AS nxt FROM bo),
nr AS (SELECT period, factor, list(DISTINCT other) AS near FROM sp JOIN ends ON period >= date AND (nxt IS NULL OR period < nxt) WHERE abs(corr) >= {limit} GROUP BY period, factor),
cd AS (SELECT tr.period, tr.factor, coalesce(near, []) AS near, row_number() OVER (PARTITION BY tr.period ORDER BY ic DESC, tr.factor) AS r FROM tr LEFT JOIN nr ON nr.period = tr.period AND nr.factor = tr.factor),
g AS (SELECT period, 0 AS k, CAST([] AS VARCHAR[]) AS taken FROM (SELECT DISTINCT period FROM cd) UNION ALL SELECT g.period, g.k + 1, CASE WHEN list_has_any(near, taken) THEN taken ELSE list_append(taken, factor) END FROM g JOIN cd ON cd.period = g.period AND cd.r = g.k + 1),
fin AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY period ORDER BY k DESC) = 1), dr AS (SELECT period, string_agg(factor, ',' ORDER BY r) FILTER (NOT list_contains(taken, factor)) AS dropped FROM cd JOIN fin USING (period) GROUP BY period),
chains(k, chain, of) AS (VALUES {_CHAINS_SQL}), sc AS (SELECT period, chain, len(list_intersect(of, themes)) / len(of) AS score FROM cov, chains QUALIFY row_number() OVER (PARTITION BY period ORDER BY score DESC, k) = 1)
SELECT cnt.period, coalesce(array_to_string(taken, ','), '') AS selected, coalesce(dropped, '') AS dropped, coalesce(array_to_string(cov.themes, ','), '') AS themes, CASE WHEN score > 0 THEN chain END AS chain, round(coalesce(score, 0) + {NUDGE}, 6) AS chain_score, n_alive, n_decaying, n_dead
FROM cnt LEFT JOIN fin USING (period) LEFT JOIN dr USING (period) LEFT JOIN cov USING (period) LEFT JOIN sc USING (period)"""


@query(_selection_sql())
def eval_periodic_selection(spark, sf_dir):
    f = six(spark, sf_dir)
    ends = month_ends(f)
    pairs = correlations.rolling_factor_correlation(f, list(_SIX), 60, True, ends)
    themes = spark.createDataFrame(list(_THEMES.items()), "factor string, themes array<string>")
    s = selection.periodic_selection(six_states(f), pairs, themes, ends, least_ir=0.3, limit=0.2, most=4, wait=2)
    return s.select("period", *(F.array_join(c, ",").alias(c) for c in ("selected", "dropped", "themes")), "chain", _r("chain_score"), "n_alive", "n_decaying", "n_dead")


# ------------------------------------------------------------------------------------------------- blends by market state

_LEVEL = f"""{BRAND_PANEL_SQL}, q0 AS (SELECT date, code, close / nullif(lag(close) OVER (PARTITION BY code ORDER BY date), 0) - 1 AS ret FROM panel), mk AS (SELECT date, avg(greatest(-0.1, least(0.1, ret))) / 10 AS m FROM q0 WHERE ret IS NOT NULL GROUP BY date),
st AS (SELECT date, m, exp(sum(ln(1 + m)) OVER (ORDER BY date)) AS level, CASE WHEN avg(m) OVER (ORDER BY date ROWS 19 PRECEDING) > 0.001 THEN 'bull' WHEN avg(m) OVER (ORDER BY date ROWS 19 PRECEDING) < -0.001 THEN 'bear' ELSE 'osc' END AS state FROM mk)"""


def market_level(spark, sf_dir):
    """date, m (a tenth of the mean return, each within a tenth), level, state (bull, bear or osc by the mean of 20 dates)."""
    from pyspark.sql import Window as W

    by = W.orderBy("date")  # a row a date
    d = returns(spark, sf_dir).where("ret IS NOT NULL").groupBy("date").agg((F.avg(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), "ret"))) / 10).alias("m"))
    mean = F.avg("m").over(by.rowsBetween(-19, 0))
    return d.select("date", "m", F.exp(F.sum(F.log1p("m")).over(by)).alias("level"), F.when(mean > 0.001, "bull").when(mean < -0.001, "bear").otherwise("osc").alias("state"))


_TWO_ICS = _SIX_ICS + f", {_LEVEL}, pv AS (SELECT date, max(ic) FILTER (factor = 'mom5') AS first, max(ic) FILTER (factor = 'rev3') AS second FROM ic GROUP BY date), si AS (SELECT pv.date, first, second, coalesce(state, 'osc') AS state, row_number() OVER (ORDER BY pv.date) AS i FROM pv LEFT JOIN st ON st.date = pv.date)"
_STATE_WEIGHTS = _TWO_ICS + """, sw AS (SELECT date, state, count(*) OVER w AS n, avg(first) OVER w AS a, avg(second) OVER w AS b FROM si WINDOW w AS (PARTITION BY state ORDER BY i RANGE BETWEEN 99 PRECEDING AND 1 PRECEDING)),
wt AS (SELECT date, state, CASE WHEN n >= 20 AND a + b > 0 AND abs(a) > 1e-9 THEN greatest(0.15, least(0.85, a / (a + b))) ELSE 0.5 END AS weight FROM sw)"""


def _two_ics(f):
    ics = selection.daily_ics(f, ["mom5", "rev3"], "label")
    of = lambda name: F.max(F.when(F.col("factor") == name, F.col("ic")))
    return ics.groupBy("date").agg(of("mom5").alias("first"), of("rev3").alias("second"))


_TWO_SQL = _STATE_WEIGHTS.replace(f"UNPIVOT (SELECT date, code, label, {', '.join(_SIX)} FROM f1 WHERE label IS NOT NULL) ON {', '.join(_SIX)}", "UNPIVOT (SELECT date, code, label, mom5, rev3 FROM f1 WHERE label IS NOT NULL) ON mom5, rev3")


@query(_TWO_SQL + f" SELECT date, state, {_sqlr('weight')} FROM wt")
def blend_state_weights(spark, sf_dir):
    return blends.state_weights(_two_ics(six(spark, sf_dir)), market_level(spark, sf_dir).select("date", "state"), 100).select("date", "state", _r("weight"))


_PCT = "CASE WHEN {0} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {0}) + (count(*) OVER (PARTITION BY date, {0}) - 1) / 2.0) / count({0}) OVER (PARTITION BY date) END"


@query(_TWO_SQL + f", pr AS (SELECT date, code, {_PCT.format('mom5')} AS a, {_PCT.format('rev3')} AS b FROM f1) SELECT pr.date, code, round(coalesce(weight, 0.5) * a + (1 - coalesce(weight, 0.5)) * b + {NUDGE}, 6) AS blended FROM pr LEFT JOIN wt ON wt.date = pr.date")
def blend_state_signal(spark, sf_dir):
    f = six(spark, sf_dir)
    weights = blends.state_weights(_two_ics(f), market_level(spark, sf_dir).select("date", "state"), 100)
    return blends.state_blend(f.select("date", "code", "mom5", "rev3"), "mom5", "rev3", weights).select("date", "code", _r("blended"))


_FOLDS_SQL = _SIX_ICS + f""", {_LEVEL}, dy AS (SELECT d.date, row_number() OVER (ORDER BY d.date) AS i, count(*) OVER () AS n, state FROM (SELECT DISTINCT date FROM ic) d LEFT JOIN st ON st.date = d.date),
fo AS (SELECT unnest(range(0, 1 + CAST(floor((n - 205) / 50) AS BIGINT))) AS fold FROM (SELECT max(n) AS n FROM dy)), tr AS (SELECT fold, date, i, state FROM dy, fo WHERE i > fold * 50 AND i <= fold * 50 + 150), nw AS (SELECT fold, arg_max(state, i) AS state FROM tr GROUP BY fold),
sm AS (SELECT fold, nw.state, factor, avg(ic) AS m, stddev_samp(ic) AS s, count(ic) AS n, avg(ic) FILTER (tr.state = nw.state) AS ms, count(ic) FILTER (tr.state = nw.state) AS ns FROM tr JOIN nw USING (fold) JOIN ic ON ic.date = tr.date GROUP BY ALL),
pk AS (SELECT *, coalesce(ns >= 10 AND ms > 0, FALSE) AS picked, coalesce(n >= 10 AND m > 0, FALSE) AS wide FROM sm), pn AS (SELECT *, picked OR (count(*) FILTER (picked) OVER (PARTITION BY fold) < 3 AND wide) AS taken FROM pk), pa AS (SELECT *, bool_or(taken) OVER (PARTITION BY fold) AS any_taken FROM pn),
sets AS (SELECT fold, state, factor, CASE WHEN coalesce(s > 1e-9, FALSE) AND m < 0 THEN -1.0 ELSE 1.0 END AS orient, CASE WHEN coalesce(s > 1e-9, FALSE) THEN m / s * sqrt(252) ELSE 1.0 END AS weight FROM pa WHERE CASE WHEN any_taken THEN taken ELSE coalesce(s > 1e-9, FALSE) AND m > 0 END)"""


def _sets(f, spark, sf_dir):
    return blends.state_factor_sets(selection.daily_ics(f, list(_SIX), "label"), market_level(spark, sf_dir).select("date", "state"), 150, 50, 5)


@query(_FOLDS_SQL + f" SELECT CAST(fold AS INT) AS fold, state, factor, CAST(orient AS DOUBLE) AS orient, {_sqlr('weight')} FROM sets")
def blend_factor_sets(spark, sf_dir):
    return _sets(six(spark, sf_dir), spark, sf_dir).select("fold", "state", "factor", "orient", _r("weight"))


@query(_FOLDS_SQL + f""", vs AS (SELECT date, code, factor, v AS value FROM long WHERE date IN (SELECT date FROM ic)), dl AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM vs)), te AS (SELECT date, CAST(floor((i - 156) / 50) AS INT) AS fold FROM dl WHERE i > 155 AND 155 + (CAST(floor((i - 156) / 50) AS INT) + 1) * 50 <= n),
rv AS (SELECT date, code, factor, (rank() OVER (PARTITION BY date, factor ORDER BY value) + (count(*) OVER (PARTITION BY date, factor, value) - 1) / 2.0) / count(*) OVER (PARTITION BY date, factor) - 0.5 AS value FROM vs),
fs AS (SELECT date, factor, CASE WHEN lag(ic, 2) OVER (PARTITION BY factor ORDER BY date) > 0.1234 THEN 1 WHEN lag(ic, 2) OVER (PARTITION BY factor ORDER BY date) < -0.1234 THEN -1 ELSE 0 END AS label FROM ic),
jo AS (SELECT rv.date, code, te.fold, orient * weight * CASE label WHEN 1 THEN 1.0 WHEN -1 THEN 0.3 ELSE 0.7 END AS w, value FROM rv JOIN te ON te.date = rv.date JOIN sets ON sets.fold = te.fold AND sets.factor = rv.factor LEFT JOIN fs ON fs.date = rv.date AND fs.factor = rv.factor)
SELECT date, code, fold, round(sum(w * value) / nullif(sum(abs(w)), 0) + {NUDGE}, 5) AS signal FROM jo GROUP BY date, code, fold""")
def blend_dual_signal(spark, sf_dir):
    from pyspark.sql import Window as W

    f = six(spark, sf_dir)
    ics = selection.daily_ics(f, list(_SIX), "label")
    long = f.where("label IS NOT NULL").unpivot(["date", "code"], list(_SIX), "factor", "_v").where("_v IS NOT NULL").join(F.broadcast(ics.select("date").distinct()), "date", "left_semi")
    at = W.partitionBy("date", "factor")
    rank = (F.rank().over(at.orderBy("_v")) + (F.count(F.lit(1)).over(W.partitionBy("date", "factor", "_v")) - 1) / 2) / F.count(F.lit(1)).over(at) - 0.5
    before = F.lag("ic", 2).over(W.partitionBy("factor").orderBy("date"))
    states = ics.select("date", "factor", F.when(before > 0.1234, 1).when(before < -0.1234, -1).otherwise(0).alias("label"))
    return blends.state_signal(long.select("date", "code", "factor", rank.alias("value")), _sets(f, spark, sf_dir), states, 150, 50, 5).select("date", "code", "fold", _r("signal", 5))


@query(f"""WITH {_LEVEL}, a AS (SELECT date, min(level) OVER w / level - 1 AS worst, count(*) OVER w = 20 AS known FROM st WINDOW w AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), b AS (SELECT *, CAST(worst < -0.03 AS INT) AS tail FROM a)
SELECT date, {_sqlr('worst')}, tail, known, round(greatest(0.3, least(1, 1 - 1.5 * lag(tail, 20) OVER (ORDER BY date) * 0.4)) + {NUDGE}, 6) AS kept FROM b QUALIFY lag(tail, 20) OVER (ORDER BY date) IS NOT NULL""")
def blend_tail_gate(spark, sf_dir):
    from pyspark.sql import Window as W

    t = blends.tail_labels(market_level(spark, sf_dir), "level", 20, -0.03)
    t = t.withColumn("_p", F.lag("tail", 20).over(W.orderBy("date")).cast("double"))
    return t.where("_p IS NOT NULL").withColumn("kept", blends.gate_weight(F.col("_p"), F.lit(0.4))).select("date", _r("worst"), "tail", "known", _r("kept"))


@query(f"""WITH RECURSIVE {_RETURNS}, s AS (SELECT date, code, ret, CASE WHEN ret < -0.9 THEN least(1, -ret / 4) ELSE 0.0 END AS stress, ret > 3 AS safe, row_number() OVER (PARTITION BY code ORDER BY date) AS i FROM r), t AS (SELECT code, i FROM s WHERE stress > 0.01),
h AS (SELECT code, min(i) AS i FROM t GROUP BY code UNION ALL SELECT h.code, (SELECT min(t.i) FROM t WHERE t.code = h.code AND t.i >= h.i + 10) FROM h WHERE EXISTS (SELECT 1 FROM t WHERE t.code = h.code AND t.i >= h.i + 10)),
c AS (SELECT s.*, (SELECT max(h.i) FROM h WHERE h.code = s.code AND h.i <= s.i) AS from_i FROM s), d AS (SELECT *, coalesce(bool_or(coalesce(safe, FALSE)) OVER (PARTITION BY code, from_i ORDER BY i), FALSE) AS gone FROM c)
SELECT date, code, round(CASE WHEN stress > 0.01 AND i < from_i + 10 AND NOT gone THEN greatest(stress, 0.3) ELSE stress END + {NUDGE}, 6) AS cooled FROM d""")
def signal_cooldown(spark, sf_dir):
    r = returns(spark, sf_dir).withColumns({"stress": F.when(F.col("ret") < -0.9, F.least(F.lit(1.0), -F.col("ret") / 4)).otherwise(0.0), "safe": F.col("ret") > 3})
    return selection.suppressed(r, "stress", "safe", hold=10, series=["code"]).select("date", "code", _r("cooled"))


@query(f"""WITH RECURSIVE {BRAND_PANEL_SQL}, a AS (SELECT code, date AS ts, close, avg(close) OVER w5 AS fast, avg(close) OVER w20 AS slow, avg(close) OVER v5 AS f, avg(close) OVER v20 AS s, row_number() OVER (PARTITION BY code ORDER BY date, close) AS i FROM panel WHERE close IS NOT NULL
  WINDOW w5 AS (PARTITION BY code ORDER BY date, close ROWS 4 PRECEDING), w20 AS (PARTITION BY code ORDER BY date, close ROWS 19 PRECEDING), v5 AS (PARTITION BY code ORDER BY date, close ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), v20 AS (PARTITION BY code ORDER BY date, close ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, CASE WHEN fast > slow AND f <= s THEN 1 WHEN fast < slow AND f >= s THEN -1 END AS side FROM a WHERE i > 20), c AS (SELECT *, coalesce(lag(side) OVER (PARTITION BY code ORDER BY i), 0) AS was FROM b WHERE side IS NOT NULL)
SELECT code, ts, {_sqlr('close', 'fast', 'slow', digits=4)}, CASE WHEN was = 0 AND side = 1 THEN 'buy' WHEN was = -1 THEN 'cover,buy' WHEN was = 0 THEN 'short' ELSE 'sell,short' END AS action, side AS position FROM c WHERE side != was""")
def signal_ma_cross(spark, sf_dir):
    return signals.ma_cross(brand_panel(spark, sf_dir), 5, 20, False, time="date").select("code", "ts", _r("close", 4), _r("fast", 4), _r("slow", 4), "action", "position")
