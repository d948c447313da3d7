"""The registered queries of the panel library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import NUDGE, Compiler, Expr, digest
from .operators.catalog import operators
from .plans import alpha101, factors, short_horizon
from .plans.panel import BRAND_PANEL_SQL, brand_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _factor_query(name: str, exprs: dict[str, Expr], digits: int = 6) -> None:
    """A query of named expressions on the brand panel; computed numbers are rounded so that two engines can be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = Compiler(exprs).apply(brand_panel(spark, sf_dir))
        return found.select("date", "code", *(digest(n, digits) for n in exprs))

    QUERIES[name] = run
    sql = Compiler(exprs).to_sql(BRAND_PANEL_SQL, digits=digits)
    if sql:
        ORACLES[name] = sql


for _name, _expr in operators().items():
    _factor_query(_name, {"value": _expr})
_factor_query("zoo_bar_shapes", factors.bar_shapes())
for _n in factors.WINDOWS:
    _factor_query(f"zoo_window_{_n}", factors.window_features(_n))
_factor_query("zoo_academic", factors.academic())
_factor_query("zoo_daily", factors.daily_set())
_alphas = alpha101.alphas()
for _lo in range(1, 102, 10):
    _factor_query(f"zoo_alpha101_{_lo:03d}", {f"alpha_{k:03d}": _alphas[f"alpha_{k:03d}"] for k in range(_lo, min(_lo + 10, 102))})

# Factors with a recursion along the series can't be stated in SQL; they are kept apart so that the others can be checked.
_short = short_horizon.factors()
_plain = [n for n, e in _short.items() if all(k != "seq" for k, _ in Compiler({n: e}).stages())]
for _lo in range(0, len(_plain), 12):
    _factor_query(f"zoo_short_{_plain[_lo][6:]}", {n: _short[n] for n in _plain[_lo : _lo + 12]})
_factor_query("zoo_short_recursive", {n: e for n, e in _short.items() if n not in _plain})


# ---------------------------------------------------------------------------------------------------------------- panels

from .functions import expr as X  # noqa: E402
from .operators import correlations, evaluation, indicators, joins, metrics, simulation, text, validation  # noqa: E402
from .plans.panel import USER_PANEL_SQL, check_prices, table, user_panel  # noqa: E402

C = X.col("close")
MOMENTUM = {"factor": C / X.delay(C, 5) - 1, "label": X.lead(C, 2) / X.lead(C, 1) - 1}
_LABELLED = "f AS (" + Compiler(MOMENTUM).to_sql("panel AS (SELECT * FROM panel0)", digits=None).replace("WITH panel AS (SELECT * FROM panel0),\n", "WITH ").replace(" FROM panel)", " FROM panel0)") + ")"
_BASE = "WITH " + BRAND_PANEL_SQL.replace("panel AS", "panel0 AS", 1) + ",\n" + _LABELLED
_ICS = """,
pairs AS (SELECT date, code, factor, label FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
ranked AS (SELECT date, code,
    (rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS rf,
    (rank() OVER (PARTITION BY date ORDER BY label) + (count(*) OVER (PARTITION BY date, label) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS ry FROM pairs),
ic AS (SELECT date, covar_samp(rf, ry) / (stddev_samp(rf) * stddev_samp(ry)) AS ic, count(*) AS n FROM ranked GROUP BY date HAVING count(*) >= 5 AND stddev_samp(rf) > 1e-13 AND stddev_samp(ry) > 1e-13)"""


def _r(name: str, digits: int = 6):
    return F.round(F.col(name) + NUDGE, digits).alias(name)


def _sqlr(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n} + {NUDGE}, {digits}) AS {n}" for n in names)


def query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Compiler(MOMENTUM).apply(brand_panel(spark, sf_dir))


_BARS = ("open", "high", "low", "close", "volume", "amount", "vwap")


@query(f"WITH {BRAND_PANEL_SQL} SELECT date, code, {_sqlr(*_BARS, digits=4)}, sector FROM panel")
def panel_brand_daily(spark, sf_dir):
    return brand_panel(spark, sf_dir).select("date", "code", *(_r(c, 4) for c in _BARS), "sector")


@query(f"WITH {USER_PANEL_SQL} SELECT date, code, {_sqlr(*_BARS, digits=4)}, sector FROM panel")
def panel_user_daily(spark, sf_dir):
    return user_panel(spark, sf_dir).select("date", "code", *(_r(c, 4) for c in _BARS), "sector")


@query(f"WITH {BRAND_PANEL_SQL} SELECT date, code, {_sqlr('close', digits=4)} FROM panel WHERE NOT (high < low OR high < greatest(open, close) OR low > least(open, close) OR least(open, high, low, close) <= 0)")
def panel_checked_prices(spark, sf_dir):
    return check_prices(brand_panel(spark, sf_dir)).select("date", "code", _r("close", 4))


@query(_BASE + _ICS + f" SELECT date, {_sqlr('ic')}, n FROM ic")
def eval_daily_ic(spark, sf_dir):
    return evaluation.daily_ic(labelled(spark, sf_dir), "factor", "label").select("date", _r("ic"), "n")


@query(_BASE + _ICS + f""", s AS (SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive_share, count(*) AS n_days FROM ic),
t AS (SELECT *, ic_mean / ic_std AS ir, ic_mean / (ic_std / sqrt(n_days)) AS t_stat FROM s)
SELECT {_sqlr('ic_mean', 'ic_std', 'positive_share', 'ir', 't_stat')}, n_days, CASE WHEN abs(t_stat) < 2 OR t_stat IS NULL THEN 'dead' WHEN ic_mean > 0 THEN 'alive' ELSE 'reversed' END AS verdict FROM t""")
def eval_ic_summary(spark, sf_dir):
    s = evaluation.ic_summary(evaluation.daily_ic(labelled(spark, sf_dir), "factor", "label"))
    return s.select(_r("ic_mean"), _r("ic_std"), _r("positive_share"), _r("ir"), _r("t_stat"), "n_days", "verdict")


_GROUPS = """,
g0 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY factor, code) AS i, count(*) OVER (PARTITION BY date) AS n0 FROM f WHERE factor IS NOT NULL AND label IS NOT NULL),
g AS (SELECT date, CAST(floor((i - 1) * 5 / n0) AS INT) + 1 AS grp, avg(label) AS ret, count(*) AS n FROM g0 WHERE n0 >= 5 GROUP BY 1, 2)"""


@query(_BASE + _GROUPS + f" SELECT date, grp, {_sqlr('ret')}, n FROM g")
def eval_quantile_returns(spark, sf_dir):
    return evaluation.quantile_returns(labelled(spark, sf_dir), "factor", "label").select("date", "grp", _r("ret"), "n")


@query(_BASE + _GROUPS + f", s AS (SELECT date, max(CASE WHEN grp = 5 THEN ret END) - max(CASE WHEN grp = 1 THEN ret END) AS spread FROM g GROUP BY date) SELECT date, {_sqlr('spread')} FROM s WHERE spread IS NOT NULL")
def eval_long_short(spark, sf_dir):
    return evaluation.long_short(evaluation.quantile_returns(labelled(spark, sf_dir), "factor", "label"), 5).select("date", _r("spread"))


@query(_BASE + f""",
r AS (SELECT date, code, (rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS r FROM f WHERE factor IS NOT NULL),
d AS (SELECT date, abs(r - lag(r) OVER (PARTITION BY code ORDER BY date)) AS d FROM r), t AS (SELECT date, avg(d) AS turnover FROM d GROUP BY date)
SELECT date, {_sqlr('turnover')} FROM t WHERE turnover IS NOT NULL""")
def eval_rank_turnover(spark, sf_dir):
    return evaluation.rank_turnover(labelled(spark, sf_dir), "factor").select("date", _r("turnover"))


_PAIR = {"mom5": C / X.delay(C, 5) - 1, "size": X.log(X.col("amount")), "low_vol": -X.ts_std(C / X.delay(C, 1) - 1, 10)}


@query()
def eval_factor_correlation(spark, sf_dir):
    return correlations.factor_correlation(Compiler(_PAIR).apply(brand_panel(spark, sf_dir)), list(_PAIR)).select("a", "b", _r("corr"), "n_days")


# ---------------------------------------------------------------------------------------------------------------- joins


@query("""SELECT l.event_id, l.user_id, coalesce(r.event_id, -1) AS click_id, round(r.value + 1.7e-8, 6) AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").withColumnRenamed("event_id", "id"), "user_id", "ts", "ts", ["id", "value"], "click_")
    return found.select("event_id", "user_id", F.coalesce("click_id", F.lit(-1)).alias("click_id"), _r("click_value"))


@query(f"""WITH {USER_PANEL_SQL}, e AS (SELECT user_id, CAST(ts AS DATE) AS d, value / 1000 AS s FROM events WHERE event_type = 'error'),
j AS (SELECT p.date, p.code, count(e.s) AS event_count, coalesce(sum(e.s * exp(-0.1 * (p.date - e.d))), 0) AS x FROM panel p LEFT JOIN e ON e.user_id = p.code AND e.d <= p.date AND e.d > p.date - 7 GROUP BY 1, 2)
SELECT date, code, round(greatest(-1, least(1, x)) + {NUDGE}, 6) AS event_score, event_count FROM j""")
def join_decayed_events(spark, sf_dir):
    bars = user_panel(spark, sf_dir).select("date", "code")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumnRenamed("user_id", "code")
    return joins.decayed_events(bars, e, "code", "date", "ts", F.col("value") / 1000, 7, 0.1).select("date", "code", _r("event_score"), "event_count")


def journal(spark, sf_dir):
    """Trades from events: purchases buy, clicks sell."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    side = F.when(F.col("event_type") == "purchase", "buy").otherwise("sell")
    q = F.get_json_object("props", "$.k").cast("double") + 1
    return e.select(F.col("event_id").alias("trade_id"), F.col("ts").alias("datetime"), F.col("user_id").alias("symbol"), side.alias("side"), q.alias("quantity"), F.col("value").alias("price"), (F.col("value") * q * 0.0005).alias("fee"))


@query()
def journal_fifo_round_trips(spark, sf_dir):
    return joins.fifo_lots(journal(spark, sf_dir)).select("symbol", "buy_id", "sell_id", "matched", _r("pnl", 4))


@query()
def journal_stats_by_symbol(spark, sf_dir):
    return metrics.trade_stats(joins.fifo_lots(journal(spark, sf_dir)), ["symbol"]).select("symbol", "n_trades", _r("win_rate"), _r("total_pnl", 4), _r("profit_factor"), "longest_losing_run")


@query("SELECT hour(ts) AS hour, count(*) AS n, round(sum(value) + 1.7e-8, 4) AS amount FROM events GROUP BY 1")
def agg_hourly_volume(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("amount")).select("hour", "n", _r("amount", 4))


@query("""WITH b AS (SELECT *, min(value) OVER () AS lo, max(value) OVER () AS hi FROM events)
SELECT CAST(least(19, floor((value - lo) / nullif(hi - lo, 0) * 20)) AS INT) AS bin, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS BIGINT) AS volume FROM b GROUP BY 1""")
def agg_volume_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("value", (F.get_json_object("props", "$.k").cast("long") + 1).alias("q"))
    edge = e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = e.join(F.broadcast(edge))  # one row
    at = F.least(F.lit(19), F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * 20)).cast("int")
    return b.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("volume"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice) + 1.7e-8, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""")
def agg_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    n = o.groupingSets([["n_name", "c_mktsegment"], ["n_name"], []], "n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    return n.select("n_name", "c_mktsegment", "n_orders", _r("total", 2))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    key = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o.where("o_orderstatus = 'O'").select("o_custkey"), key, "left_semi").join(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"), key, "left_anti")


@query("(SELECT 'both' AS kind, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'customer', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)) UNION ALL (SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier))")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"both": a.intersect(b), "customer": a.subtract(b), "any": a.union(b).distinct()}
    out = [df.select(F.lit(kind).alias("kind"), "k") for kind, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {BRAND_PANEL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, code) AS place FROM panel) SELECT date, code, place, volume FROM r WHERE place <= 3")
def top_k_per_date(spark, sf_dir):
    from pyspark.sql import Window as W

    p = brand_panel(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(F.desc("volume"), "code")))
    return p.where("place <= 3").select("date", "code", "place", "volume")


@query("SELECT l_partkey, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1 ORDER BY amount DESC, l_partkey LIMIT 20")
def top_k_overall(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("amount")).orderBy(F.desc("amount"), "l_partkey").limit(20)


# ------------------------------------------------------------------------------------------------------ metrics, validation


def nav(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("equity"))


_NAV = "n AS (SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS equity FROM orders GROUP BY 1)"


@query(f"WITH {_NAV}, p AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak FROM n) SELECT date, round((equity - peak) / peak + {NUDGE}, 6) AS drawdown FROM p")
def metrics_drawdowns(spark, sf_dir):
    return metrics.drawdowns(nav(spark, sf_dir)).select("date", _r("drawdown"))


@query(f"""WITH {_NAV}, r AS (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM n),
s AS (SELECT count(r) AS n_bars, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, avg(r) AS m, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn, min(dd) AS max_drawdown FROM r)
SELECT n_bars, {_sqlr('total_return')}, round(pow(1 + total_return, 252.0 / n_bars) - 1 + {NUDGE}, 6) AS annual_return, round(sd * sqrt(252) + {NUDGE}, 6) AS volatility, round(m / (sd + 1e-10) * sqrt(252) + {NUDGE}, 6) AS sharpe,
round(m / (dn + 1e-10) * sqrt(252) + {NUDGE}, 6) AS sortino, {_sqlr('max_drawdown')}, round((pow(1 + total_return, 252.0 / n_bars) - 1) / abs(max_drawdown) + {NUDGE}, 6) AS calmar FROM s""")
def metrics_curve(spark, sf_dir):
    s = metrics.curve_metrics(nav(spark, sf_dir))
    return s.select("n_bars", *(_r(c) for c in s.columns if c != "n_bars"))


@query(f"WITH {_NAV}, r AS (SELECT date, equity / lag(equity) OVER (ORDER BY date) - 1 AS r FROM n), k AS (SELECT *, ntile(5) OVER (ORDER BY date) AS fold FROM r WHERE r IS NOT NULL) SELECT fold, count(r) AS n, round(avg(r) + {NUDGE}, 6) AS mean, round(avg(r) / (stddev_samp(r) + 1e-10) * sqrt(252) + {NUDGE}, 6) AS sharpe FROM k GROUP BY fold")
def validation_walk_forward(spark, sf_dir):
    from pyspark.sql import Window as W

    r = nav(spark, sf_dir).withColumn("r", F.col("equity") / F.lag("equity").over(W.orderBy("date")) - 1).where("r IS NOT NULL")
    return validation.walk_forward(r, "r").select("fold", "n", _r("mean"), _r("sharpe"))


@query("""WITH p AS (SELECT p_partkey AS name, (p_size * 37 + p_partkey) % 997 / 997.0 + 0.0001 AS p_value FROM part), r AS (SELECT *, least(1, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value, name)) AS raw FROM p)
SELECT name, round(min(raw) OVER (ORDER BY p_value, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 1.7e-8, 6) AS q FROM r""")
def validation_false_discovery(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), ((F.col("p_size") * 37 + F.col("p_partkey")) % 997 / 997.0 + 0.0001).alias("p_value"))
    return validation.benjamini_hochberg(p).select("name", _r("q"))


# -------------------------------------------------------------------------------------------------- indicators, backtests

for _name, _exprs in {"indicator_bollinger": indicators.bollinger(), "indicator_obv": indicators.obv(), "indicator_hist_vol": indicators.historical_volatility(), "indicator_regime": indicators.regime()}.items():
    _factor_query(_name, _exprs)


@query()
def indicator_recursive(spark, sf_dir):
    f = indicators.recursive(brand_panel(spark, sf_dir))
    return f.select("date", "code", *(_r(c) for c in f.columns[2:]))


@query(f"""WITH {BRAND_PANEL_SQL}, s AS (SELECT code, date, coalesce(sign(close - lag(close) OVER (PARTITION BY code ORDER BY date)), 0) AS s FROM panel),
n AS (SELECT *, CASE WHEN s != coalesce(lag(s) OVER (PARTITION BY code ORDER BY date), 9) THEN 1 ELSE 0 END AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY code ORDER BY date) AS island FROM n)
SELECT code, date, CAST(s * row_number() OVER (PARTITION BY code, island ORDER BY date) AS INT) AS streak FROM i""")
def indicator_streaks(spark, sf_dir):
    return indicators.streaks(brand_panel(spark, sf_dir))


def _aligned(spark, sf_dir):
    signal = {"signal": X.sign(C / X.delay(C, 5) - 1)}
    return simulation.align_signals(Compiler(signal).apply(brand_panel(spark, sf_dir), keep=("open", "close")), "signal")


@query(f"""WITH {BRAND_PANEL_SQL}, g AS (SELECT date, code, open, sign(close / lag(close, 5) OVER w - 1) AS signal FROM panel WINDOW w AS (PARTITION BY code ORDER BY date)),
h AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS held FROM g),
r AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY code ORDER BY date), 0) AS raw FROM h), a AS (SELECT *, raw / greatest(sum(abs(raw)) OVER (PARTITION BY date), 1) AS weight FROM r),
m AS (SELECT *, coalesce(lead(open) OVER w / open - 1, 0) AS nxt, abs(weight - coalesce(lag(weight) OVER w, 0)) AS moved FROM a WINDOW w AS (PARTITION BY code ORDER BY date))
SELECT date, round(sum(weight * nxt) - 0.001 * sum(moved) + {NUDGE}, 6) AS ret, round(sum(moved) + {NUDGE}, 6) AS turnover FROM m GROUP BY date""")
def backtest_portfolio_returns(spark, sf_dir):
    return simulation.portfolio_returns(_aligned(spark, sf_dir)).select("date", _r("ret"), _r("turnover"))


@query()
def backtest_simulation(spark, sf_dir):
    runs = _aligned(spark, sf_dir).withColumn("run", F.explode(F.array(*(F.lit(s) for s in range(5))))).withColumn("weight", F.col("weight") * (F.col("run") + 1) / 500)
    return simulation.simulate(runs, "us_equity").select("run", "date", _r("cash", 2), _r("equity", 2), "trades")


# ------------------------------------------------------------------------------------------------------------------- text


@query()
def text_search(spark, sf_dir):
    return text.search(table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "the thing attention", "id", "text").select("id", _r("score"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_transform(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) AS w FROM conversations),
c AS (SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('the', 'la', 'die'))) AS p, len(list_filter(w, lambda x: x IN ('of', 'de', 'und'))) AS n FROM w)
SELECT concat_ws(':', conv_id, turn) AS id, CAST(p + n AS INT) AS hits, round(coalesce((p - n) / nullif(p + n, 0), 0) + 1.7e-8, 6) AS score FROM c""")
def text_lexicon(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return text.lexicon_score(c, ["the", "la", "die"], ["of", "de", "und"], "id", "text").select("id", "hits", _r("score"))


# ---------------------------------------------------------------------------------------------------------------- journal

from .operators import journal as J  # noqa: E402

_TRADES = """t0 AS (SELECT event_id AS trade_id, ts AS datetime, user_id AS symbol, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS quantity, value AS price FROM events WHERE event_type IN ('purchase', 'click')),
trades AS (SELECT *, price * quantity * 0.0005 AS fee FROM t0)"""
_TRIPS = f"""{_TRADES},
r AS (SELECT *, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol ORDER BY datetime, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades),
s AS (SELECT *, greatest(0, -min(cum) OVER (PARTITION BY symbol ORDER BY datetime, trade_id ROWS UNBOUNDED PRECEDING)) AS short FROM r),
f AS (SELECT *, CASE WHEN side = 'buy' THEN quantity ELSE quantity - (short - coalesce(lag(short) OVER (PARTITION BY symbol ORDER BY datetime, trade_id), 0)) END AS filled FROM s),
x AS (SELECT *, sum(filled) OVER (PARTITION BY symbol, side ORDER BY datetime, trade_id ROWS UNBOUNDED PRECEDING) AS hi FROM f),
trips AS (SELECT b.symbol, b.trade_id AS buy_id, z.trade_id AS sell_id, b.datetime AS buy_at, z.datetime AS sell_at, least(b.hi, z.hi) - greatest(b.hi - b.filled, z.hi - z.filled) AS matched,
    (z.price - b.price) * (least(b.hi, z.hi) - greatest(b.hi - b.filled, z.hi - z.filled)) - b.fee * (least(b.hi, z.hi) - greatest(b.hi - b.filled, z.hi - z.filled)) / b.quantity - z.fee * (least(b.hi, z.hi) - greatest(b.hi - b.filled, z.hi - z.filled)) / z.quantity AS pnl
  FROM x b JOIN x z ON b.symbol = z.symbol AND b.side = 'buy' AND z.side = 'sell' AND b.filled > 0 AND z.filled > 0 AND b.hi - b.filled < z.hi AND z.hi - z.filled < b.hi)"""
ORACLES["journal_fifo_round_trips"] = f"WITH {_TRIPS} SELECT symbol, buy_id, sell_id, matched, {_sqlr('pnl', digits=4)} FROM trips"
ORACLES["journal_stats_by_symbol"] = f"""WITH {_TRIPS}, w AS (SELECT *, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY sell_at, sell_id, buy_id ROWS UNBOUNDED PRECEDING) AS island FROM trips),
l AS (SELECT symbol, max(n) AS longest_losing_run FROM (SELECT symbol, island, count(*) AS n FROM w WHERE pnl < 0 GROUP BY 1, 2) GROUP BY 1)
SELECT symbol, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) + {NUDGE}, 6) AS win_rate, round(sum(pnl) + {NUDGE}, 4) AS total_pnl, round(sum(CASE WHEN pnl > 0 THEN pnl END) / sum(CASE WHEN pnl < 0 THEN -pnl END) + {NUDGE}, 6) AS profit_factor,
  coalesce(any_value(longest_losing_run), 0) AS longest_losing_run FROM trips LEFT JOIN l USING (symbol) GROUP BY symbol"""


def _severity_sql(kind: str) -> str:
    medium, high = J.SEVERITIES[kind]
    return f"CASE WHEN score >= {high} THEN 'high' WHEN score >= {medium} THEN 'medium' ELSE 'low' END AS severity"


@query(f"""WITH {_TRIPS}, h AS (SELECT *, (epoch_us(sell_at) - epoch_us(buy_at)) / 86400000000.0 AS d FROM trips), a AS (SELECT avg(CASE WHEN pnl > 0 THEN d END) AS winner_days, avg(CASE WHEN pnl < 0 THEN d END) AS loser_days FROM h),
b AS (SELECT *, loser_days / winner_days AS score FROM a) SELECT {_sqlr('winner_days', 'loser_days', 'score')}, {_severity_sql('disposition')} FROM b""")
def journal_disposition(spark, sf_dir):
    return J.disposition(joins.fifo_lots(journal(spark, sf_dir))).select(_r("winner_days"), _r("loser_days"), _r("score"), "severity")


@query(f"""WITH {_TRIPS}, d AS (SELECT CAST(datetime AS DATE) AS day, count(*) AS n FROM trades GROUP BY 1), c AS (SELECT quantile_cont(n, 0.75) AS busy, quantile_cont(n, 0.25) AS quiet FROM d),
m AS (SELECT avg(CASE WHEN n >= busy THEN pnl END) AS busy_pnl, avg(CASE WHEN n <= quiet THEN pnl END) AS quiet_pnl FROM trips JOIN d ON d.day = CAST(sell_at AS DATE), c),
b AS (SELECT *, CASE WHEN quiet_pnl > busy_pnl THEN (quiet_pnl - busy_pnl) / abs(quiet_pnl) ELSE 0 END AS score FROM m) SELECT {_sqlr('busy_pnl', 'quiet_pnl', digits=4)}, {_sqlr('score')}, {_severity_sql('overtrading')} FROM b""")
def journal_overtrading(spark, sf_dir):
    t = journal(spark, sf_dir)
    return J.overtrading(t, joins.fifo_lots(t)).select(_r("busy_pnl", 4), _r("quiet_pnl", 4), _r("score"), "severity")


@query(f"""WITH {_TRADES}, b AS (SELECT price, lag(price, 3) OVER (PARTITION BY symbol ORDER BY datetime, trade_id) AS p3 FROM trades WHERE side = 'buy'), s AS (SELECT avg(CASE WHEN price > p3 * 1.03 THEN 1.0 ELSE 0.0 END) AS score, count(*) AS n_buys FROM b WHERE p3 IS NOT NULL)
SELECT {_sqlr('score')}, n_buys, {_severity_sql('chasing')} FROM s""")
def journal_chasing(spark, sf_dir):
    return J.chasing(journal(spark, sf_dir)).select(_r("score"), "n_buys", "severity")


@query(f"""WITH {_TRADES}, g AS (SELECT symbol, avg(price) AS m, stddev_samp(price) AS sd FROM trades GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT avg(CASE WHEN sd / m < 0.05 THEN 1.0 ELSE 0.0 END) AS score, count(*) AS n_symbols FROM g WHERE m != 0)
SELECT {_sqlr('score')}, n_symbols, {_severity_sql('anchoring')} FROM s""")
def journal_anchoring(spark, sf_dir):
    return J.anchoring(journal(spark, sf_dir)).select(_r("score"), "n_symbols", "severity")


@query(f"""WITH {_TRIPS}, t AS (SELECT count(*) AS n_trades, date_diff('day', min(datetime), max(datetime)) / 7.0 AS weeks FROM trades),
d AS (SELECT CAST(sell_at AS DATE) AS day, sum(pnl) AS p FROM trips GROUP BY 1), c AS (SELECT day, sum(p) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS c FROM d),
k AS (SELECT c - greatest(max(c) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS fall FROM c), fl AS (SELECT min(fall) AS max_fall FROM k),
q AS (SELECT count(*) AS n_round_trips, avg((epoch_us(sell_at) - epoch_us(buy_at)) / 86400000000.0) AS mean_hold_days, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(CASE WHEN pnl > 0 THEN pnl END) / avg(CASE WHEN pnl < 0 THEN -pnl END) AS win_loss_ratio, sum(pnl) AS total_pnl FROM trips)
SELECT n_trades, round(n_trades / greatest(weeks, 1) + {NUDGE}, 6) AS trades_per_week, n_round_trips, {_sqlr('mean_hold_days', 'win_rate', 'win_loss_ratio')}, {_sqlr('total_pnl', 'max_fall', digits=3)} FROM t, q, fl""")
def journal_profile(spark, sf_dir):
    t = journal(spark, sf_dir)
    p = J.profile(t, joins.fifo_lots(t))
    return p.select("n_trades", _r("trades_per_week"), "n_round_trips", _r("mean_hold_days"), _r("win_rate"), _r("win_loss_ratio"), _r("total_pnl", 3), _r("max_fall", 3))


# ------------------------------------------------------------------------------------------------- selection, composites


@query(f"""WITH {BRAND_PANEL_SQL}, m AS (SELECT date, code, close / lag(close, 5) OVER (PARTITION BY code ORDER BY date) - 1 AS s FROM panel),
p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, code) AS hi, row_number() OVER (PARTITION BY date ORDER BY s, code) AS lo FROM m WHERE s IS NOT NULL)
SELECT date, code, CASE WHEN hi <= 3 THEN 1 ELSE -1 END AS position FROM p WHERE hi <= 3 OR lo <= 3""")
def select_long_short_positions(spark, sf_dir):
    from pyspark.sql import Window as W

    m = Compiler({"s": C / X.delay(C, 5) - 1}).apply(brand_panel(spark, sf_dir)).where("s IS NOT NULL")
    at = W.partitionBy("date")
    p = m.withColumn("hi", F.row_number().over(at.orderBy(F.desc("s"), "code"))).withColumn("lo", F.row_number().over(at.orderBy("s", "code")))
    return p.where("hi <= 3 OR lo <= 3").select("date", "code", F.when(F.col("hi") <= 3, 1).otherwise(-1).alias("position"))


_factor_query("composite_weighted_ranks", {"composite": X.rank(C / X.delay(C, 5) - 1) * 0.5 + X.rank(X.col("volume")) * 0.3 + X.rank(-X.ts_std(C / X.delay(C, 1) - 1, 10)) * 0.2})


@query(f"""WITH {BRAND_PANEL_SQL}, m AS (SELECT date, code, exp(close / 1000 - max(close / 1000) OVER (PARTITION BY date)) AS e FROM panel) SELECT date, code, round(e / sum(e) OVER (PARTITION BY date) + {NUDGE}, 6) AS weight FROM m""")
def weights_softmax(spark, sf_dir):
    from pyspark.sql import Window as W

    at = W.partitionBy("date")
    p = brand_panel(spark, sf_dir).withColumn("e", F.exp(F.col("close") / 1000 - F.max(F.col("close") / 1000).over(at)))
    return p.withColumn("weight", F.col("e") / F.sum("e").over(at)).select("date", "code", _r("weight"))


def catalogue(spark: SparkSession) -> DataFrame:
    """The factor catalogue: name, family and the columns each expression reads; a few hundred rows made from the library itself."""
    rows = []
    for family, exprs in {"alpha101": _alphas, "short": _short, "academic": factors.academic(), "bar": factors.bar_shapes(), **{f"window_{n}": factors.window_features(n) for n in factors.WINDOWS}}.items():
        for name, e in exprs.items():
            rows.append((name, family, sorted({x.param[0] for x in Compiler({name: e}).order if x.op == "col"})))
    return spark.createDataFrame(rows, "name string, family string, columns array<string>")


# ------------------------------------------------------------------------------------------------------- benches, options

from .operators import bench as B  # noqa: E402
from .operators import options  # noqa: E402

_FAMILY = factors.bar_shapes()
_LONG = (
    "WITH " + BRAND_PANEL_SQL.replace("panel AS", "panel0 AS", 1)
    + ",\nw AS (" + Compiler({**_FAMILY, "label": MOMENTUM["label"]}).to_sql("panel AS (SELECT * FROM panel0)", digits=None).replace("WITH panel AS (SELECT * FROM panel0),\n", "WITH ").replace(" FROM panel)", " FROM panel0)") + ")"
    + f",\nlong AS (SELECT date, code, label, factor, value FROM (UNPIVOT w ON {', '.join(_FAMILY)} INTO NAME factor VALUE value) WHERE label IS NOT NULL AND value IS NOT NULL)"
)


def _ics_sql(source: str, out: str) -> str:
    k = "PARTITION BY factor, date"
    return f""",
{out}_r AS (SELECT factor, date, (rank() OVER ({k} ORDER BY value) + (count(*) OVER ({k}, value) - 1) / 2.0) / count(*) OVER ({k}) AS f, (rank() OVER ({k} ORDER BY label) + (count(*) OVER ({k}, label) - 1) / 2.0) / count(*) OVER ({k}) AS y FROM {source}),
{out} AS (SELECT factor, date, covar_samp(f, y) / (stddev_samp(f) * stddev_samp(y)) AS ic FROM {out}_r GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_samp(f) > 1e-13 AND stddev_samp(y) > 1e-13)"""


@query(_LONG + _ics_sql("long", "ics") + f""",
s AS (SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END) AS positive_share, count(*) AS ic_count FROM ics GROUP BY 1)
SELECT factor, {_sqlr('ic_mean', 'ic_std', 'positive_share')}, round(ic_mean / ic_std + {NUDGE}, 6) AS ir, ic_count,
  CASE WHEN ic_mean > 0.02 AND positive_share >= 0.55 AND abs(ic_mean / (ic_std / sqrt(ic_count))) > 2 THEN 'alive' WHEN ic_mean < -0.02 AND abs(ic_mean / (ic_std / sqrt(ic_count))) > 2 THEN 'reversed' ELSE 'dead' END AS category FROM s""")
def bench_family(spark, sf_dir):
    s = B.bench(B.daily_ics(B.long_table(brand_panel(spark, sf_dir), _FAMILY, MOMENTUM["label"])))
    return s.select("factor", _r("ic_mean"), _r("ic_std"), _r("positive_share"), _r("ir"), "ic_count", "category")


@query(_LONG + "".join(
    f""",
h{k} AS (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY code) AS i, row_number() OVER (PARTITION BY factor, date ORDER BY md5(concat_ws('|', '{k}', factor, code, CAST(date AS VARCHAR))), code) AS h FROM long),
g{k} AS (SELECT a.date, a.code, a.factor, b.value, a.label FROM h{k} a JOIN h{k} b ON a.factor = b.factor AND a.date = b.date AND a.i = b.h)""" + _ics_sql(f"g{k}", f"rnd{k}") for k in range(2)) + _ics_sql("long", "ics") + f""",
c AS (SELECT factor, date, avg(ic) AS r FROM (SELECT * FROM rnd0 UNION ALL SELECT * FROM rnd1) GROUP BY 1, 2 HAVING count(*) = 2),
a AS (SELECT factor, date, ic - r AS a FROM ics JOIN c USING (factor, date)),
t AS (SELECT factor, avg(a) / (stddev_samp(a) / sqrt(count(a))) AS t_full, avg(a) FILTER (date < DATE '1999-01-01') / (stddev_samp(a) FILTER (date < DATE '1999-01-01') / sqrt(count(a) FILTER (date < DATE '1999-01-01'))) AS t_train,
  avg(a) FILTER (date >= DATE '1999-01-01') / (stddev_samp(a) FILTER (date >= DATE '1999-01-01') / sqrt(count(a) FILTER (date >= DATE '1999-01-01'))) AS t_test, count(*) AS ic_count FROM a GROUP BY 1)
SELECT factor, {_sqlr('t_full', 't_train', 't_test')}, ic_count, CASE WHEN ic_count < 30 THEN 'noise' WHEN t_full <= -2 THEN 'reversed_strict' WHEN t_full >= 2 AND (t_test IS NULL OR t_test >= 2) THEN 'confirmed_alive' WHEN t_full >= 2 AND t_test <= -2 THEN 'reversed_strict'
  WHEN t_full >= 2 THEN 'train_only' ELSE 'noise' END AS category FROM t""")
def bench_family_strict(spark, sf_dir):
    s = B.strict_bench(B.long_table(brand_panel(spark, sf_dir), _FAMILY, MOMENTUM["label"]), "1999-01-01", seeds=2)
    return s.select("factor", _r("t_full"), _r("t_train"), _r("t_test"), "ic_count", "category")


@query()
def option_prices(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("spot"), (F.col("p_retailprice") * (0.8 + F.col("p_size") / 125)).alias("strike"), (F.col("p_size") / 365).alias("years"))
    p = p.withColumns({"vol": options.smile(F.col("spot"), F.col("strike"), F.lit(0.25)), "call": F.col("id") % 2 == 0})
    return options.black_scholes(p, "spot", "strike", "years", 0.03, "vol", "call").select("id", *(_r(c) for c in ("price", "delta", "gamma", "theta", "vega")))


@query(f"""WITH {BRAND_PANEL_SQL}, r AS (SELECT date, code, close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1 AS r FROM panel),
v AS (SELECT date, code, CASE WHEN count(r) OVER w = 60 THEN stddev_samp(r) OVER w END AS s FROM r WINDOW w AS (PARTITION BY code ORDER BY date ROWS 59 PRECEDING)) SELECT date, code, round(1 / s / sum(1 / s) OVER (PARTITION BY date) + {NUDGE}, 6) AS weight FROM v WHERE s IS NOT NULL""")
def weights_equal_volatility(spark, sf_dir):
    from pyspark.sql import Window as W

    v = Compiler({"s": X.ts_std(C / X.delay(C, 1) - 1, 60)}).apply(brand_panel(spark, sf_dir)).where("s IS NOT NULL")
    return v.select("date", "code", F.round(1 / F.col("s") / F.sum(1 / F.col("s")).over(W.partitionBy("date")) + NUDGE, 6).alias("weight"))


# ------------------------------------------------------------------------------------------- accounts, news, large trades

from .operators import sentiment as S  # noqa: E402
from .plans import fundamental  # noqa: E402


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for accounts on the brand panel: the bar's return, the unexplained turnover and the mean price."""
    return brand_panel(spark, sf_dir).withColumns({"roe": F.try_divide("close", "open") - 1, "accruals": F.when(F.col("volume") > 20, F.col("amount") - F.col("close") * F.col("volume")), "bvps": F.col("vwap")})


@query(Compiler(fundamental.fundamentals()).to_sql(
    BRAND_PANEL_SQL.replace("panel AS", "panel0 AS", 1) + ",\npanel AS (SELECT *, close / nullif(open, 0) - 1 AS roe, CASE WHEN volume > 20 THEN amount - close * volume END AS accruals, vwap AS bvps FROM panel0)"
))
def zoo_fundamental(spark, sf_dir):
    exprs = fundamental.fundamentals()
    return Compiler(exprs).apply(_accounts(spark, sf_dir)).select("date", "code", *(digest(n) for n in exprs))


@query(f"""WITH n AS (SELECT user_id AS code, value / 100 - 0.5 AS score, event_type AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events),
a AS (SELECT code, avg(score) FILTER (place <= 20) AS score, count(*) AS articles, count(DISTINCT source) AS sources, stddev_pop(score) AS spread FROM n WHERE place <= 30 GROUP BY 1),
s AS (SELECT code, score, ln(1 + articles) * (1 + least(sources / 5, 1) * 0.5) AS heat, CASE WHEN articles >= 3 THEN spread ELSE 0 END AS divergence FROM a)
SELECT code, {_sqlr('score', 'heat', 'divergence')} FROM s""")
def sentiment_news(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), F.col("ts").alias("at"), F.col("event_id").alias("article_id"), (F.col("value") / 100 - 0.5).alias("score"), F.col("event_type").alias("source"))
    return S.news_scores(e).select("code", _r("score"), _r("heat"), _r("divergence"))


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases and clicks as reported buying and selling; sizes beyond 50 stand for institutions."""
    k = F.get_json_object("props", "$.k").cast("int")
    sign = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click")).select(
        F.col("user_id").alias("code"), F.to_date("ts").alias("date"), F.col("event_id").alias("report_id"), (F.col("value") * sign).alias("net"), F.col("value").alias("deal"), F.when(sign == 1, F.col("value")).alias("bought"), (k > 50).cast("int").alias("institutions")
    )


_BOARD = """WITH b AS (SELECT user_id AS code, CAST(ts AS DATE) AS date, event_id, CASE WHEN event_type = 'purchase' THEN value ELSE -value END AS net, value AS deal, CASE WHEN event_type = 'purchase' THEN value END AS bought,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN 1 ELSE 0 END AS institutions FROM events WHERE event_type IN ('purchase', 'click'))"""


@query(f"""{_BOARD}, d AS (SELECT min(date) AS first_date FROM (SELECT DISTINCT date FROM b ORDER BY date DESC LIMIT 20)),
s AS (SELECT code, sum(net) AS net, sum(deal) AS deal, count(*) AS n FROM b, d WHERE date >= first_date GROUP BY 1),
t AS (SELECT code, greatest(least(CASE WHEN deal > 0 THEN net / deal ELSE 0 END * ln(1 + n), 1), -1) AS board FROM s) SELECT code, {_sqlr('board')} FROM t""")
def sentiment_board(spark, sf_dir):
    return S.board_scores(_board(spark, sf_dir)).select("code", _r("board"))


@query(f"""{_BOARD}, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC, event_id DESC) AS place FROM b),
t AS (SELECT code, avg(tanh(net / greatest(coalesce(bought, 0), 1) + 0.1 * institutions)) AS seats FROM r WHERE place <= 5 GROUP BY 1) SELECT code, {_sqlr('seats')} FROM t""")
def sentiment_seats(spark, sf_dir):
    return S.seat_scores(_board(spark, sf_dir)).select("code", _r("seats"))


from . import queries_intraday, queries_learning, queries_market, queries_research, queries_selection  # noqa: E402, F401
