"""Registered queries of parameter search, importances, clusters and mergeable aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import expr as X
from .functions.expr import NUDGE
from .operators import clusters, correlations, evolution, learning, sketches
from .plans import factors
from .plans.panel import BRAND_PANEL_SQL, brand_panel, table
from .queries import Compiler, _r, _sqlr, query
from .queries_selection import _SIX, _WITH_LABEL, six


@query(f"""WITH {BRAND_PANEL_SQL}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)), f AS (SELECT *, floor(fold * n / 6) AS lo, floor((fold + 1) * n / 6) - 1 AS hi FROM d, (SELECT unnest(range(0, 6)) AS fold))
SELECT date, CAST(fold AS INT) AS fold, CASE WHEN i >= lo AND i <= hi THEN 'test' WHEN i < lo - 5 OR i > hi + 5 + 10 THEN 'train' ELSE 'left out' END AS role FROM f""")
def learning_purged_folds(spark, sf_dir):
    return learning.purged_folds(brand_panel(spark, sf_dir), 6, 5, 10)


@query()
def learning_ridge_search(spark, sf_dir):
    sets = {"all": list(_SIX), "prices": ["mom5", "low_vol", "rev3"], "volumes": ["size", "volume_jump"]}
    s = learning.search(six(spark, sf_dir), list(_SIX), "label", [0.0, 1.0, 100.0, 10_000.0], 6, 2, 5, sets)
    return s.select("subset", "penalty", _r("ic"), _r("icir"), "n_days", "place")


_WEIGHTS = [0.5, 0.1, -2.0, -0.3, 0.2, 0.05]
_MIX = ", ".join(f"{n}, lag({n}, 1) OVER w AS {n}_b, last_value({n}) OVER v AS {n}_e" for n in _SIX)
_TOTAL = lambda k: " + ".join(f"{w} * {f'coalesce({n}_b, {n}_e)' if j == k else n}" for j, (n, w) in enumerate(zip(_SIX, _WEIGHTS, strict=True)))
_VARIANTS = " UNION ALL ".join(f"SELECT date, label, {repr(n) if n else 'NULL'} AS feature, {_TOTAL(k)} AS p FROM m" for k, n in enumerate([*_SIX, None]))


@query(f"""WITH f0 AS ({Compiler(_WITH_LABEL).to_sql(BRAND_PANEL_SQL, digits=None)}), f AS (SELECT * FROM f0 WHERE label IS NOT NULL AND {' AND '.join(f'{n} IS NOT NULL' for n in _SIX)}),
m AS (SELECT date, code, label, {_MIX} FROM f WINDOW w AS (PARTITION BY date ORDER BY md5(concat_ws('|', code, CAST(date AS VARCHAR), '7')), code), v AS (PARTITION BY date ORDER BY md5(concat_ws('|', code, CAST(date AS VARCHAR), '7')), code ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
u AS ({_VARIANTS}), r AS (SELECT date, feature, rank() OVER (PARTITION BY date, feature ORDER BY p) + (count(*) OVER (PARTITION BY date, feature, p) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date, feature ORDER BY label) + (count(*) OVER (PARTITION BY date, feature, label) - 1) / 2.0 AS y FROM u),
d AS (SELECT date, feature, CASE WHEN stddev_samp(x) > 1e-13 AND stddev_samp(y) > 1e-13 THEN covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) ELSE 0 END AS ic FROM r GROUP BY ALL HAVING count(*) >= 5), a AS (SELECT feature, avg(ic) AS ic, count(*) AS n_days FROM d GROUP BY feature)
SELECT a.feature, round(b.ic - a.ic + {NUDGE}, 5) AS importance, round(a.ic + {NUDGE}, 5) AS ic, a.n_days FROM a, (SELECT ic FROM a WHERE feature IS NULL) b WHERE feature IS NOT NULL""")
def learning_permutation_importance(spark, sf_dir):
    s = learning.permutation_importance(six(spark, sf_dir), list(_SIX), "label", learning.linear(_WEIGHTS), 7)
    return s.select("feature", _r("importance", 5), _r("ic", 5), "n_days")


@query()
def cluster_factors(spark, sf_dir):
    names = factors.window_features(20)
    found = correlations.factor_correlation(Compiler(names).apply(brand_panel(spark, sf_dir)), list(names))
    items = spark.createDataFrame([(n,) for n in names], "item string")
    member, _ = clusters.average_linkage(found.select("a", "b", (1 - F.abs(F.round("corr", 6))).alias("distance")), items, 0.5)
    return member.select("item", "cluster")


_GAMMA = 1.01 / 0.99


@query(f"""WITH b AS (SELECT l_returnflag, CAST(ceil(ln(CAST(l_extendedprice AS DOUBLE)) / ln({_GAMMA})) AS BIGINT) AS k, count(*) AS n FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY k) AS upto, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM b)
SELECT l_returnflag, {', '.join(f'round(2 * pow({_GAMMA}, min(k) FILTER (upto > {q} * (total - 1))) / ({_GAMMA} + 1) + {NUDGE}, 4) AS q{round(100 * q)}' for q in (0.5, 0.9, 0.99))} FROM c GROUP BY l_returnflag""")
def sketch_quantiles(spark, sf_dir):
    s = sketches.aggregated(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", sketches.Quantiles([0.5, 0.9, 0.99]))
    return s.select("l_returnflag", *(_r(c, 4) for c in ("q50", "q90", "q99")))


@query(f"""WITH m AS (SELECT event_type, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1), c AS (SELECT event_type, n, mean, sum(pow(value - mean, 2)) AS m2, sum(pow(value - mean, 3)) AS m3, sum(pow(value - mean, 4)) AS m4 FROM events JOIN m USING (event_type) GROUP BY ALL)
SELECT event_type, CAST(n AS DOUBLE) AS n, {_sqlr('mean', digits=5)}, round(sqrt(m2 / (n - 1)) + {NUDGE}, 5) AS sd, round(sqrt(n) * m3 / pow(m2, 1.5) + {NUDGE}, 5) AS skew, round(n * m4 / (m2 * m2) - 3 + {NUDGE}, 5) AS kurtosis FROM c""")
def sketch_moments(spark, sf_dir):
    s = sketches.aggregated(table(spark, sf_dir, "events"), ["event_type"], "value", sketches.Moments())
    return s.select("event_type", "n", *(_r(c, 5) for c in ("mean", "sd", "skew", "kurtosis")))


@query()
def evolve_factors(spark, sf_dir):
    label = X.lead(X.col("close"), 2) / X.lead(X.col("close"), 1) - 1
    found = evolution.evolve(brand_panel(spark, sf_dir), ["open", "high", "low", "close", "volume"], label, 10, 2)
    return found.where("front").select("generation", "formula", _r("icir"), _r("turnover"), _r("ic"))
