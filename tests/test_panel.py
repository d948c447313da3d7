"""The panel library against DuckDB, pandas and sequential code."""

import sys
from collections import defaultdict, deque
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lattiq import queries as Q  # noqa: E402
from lattiq.functions import expr as X  # noqa: E402
from lattiq.operators import indicators, joins, simulation, validation  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = ["op_rank", "op_ts_rank", "op_ts_corr", "op_decay_linear", "op_neutralize", "op_ts_quantile", "zoo_bar_shapes", "zoo_window_5", "eval_ic_summary", "join_asof", "join_decayed_events", "metrics_curve", "set_operations", "backtest_portfolio_returns",
           "intraday_daily_factors", "daily_bar_factors", "signal_candlesticks", "research_tick_structure", "research_stacked_ridge", "eval_lifecycle", "eval_factor_correlation", "text_search", "option_prices"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(pdf: pd.DataFrame) -> list:
    cell = lambda v: "" if v is None or v is pd.NA or v != v else f"{float(v):.6f}" if isinstance(v, (float, np.floating)) else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted(tuple(cell(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(Q.ORACLES[name]).fetchdf())


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(42)
    x = pd.DataFrame(rng.standard_normal((60, 6)), columns=list("ABCDEF"), index=pd.date_range("2024-01-01", periods=60))
    x.iloc[10, 2] = x.iloc[30, 5] = x.iloc[50, 0] = np.nan
    x["D"] = x["D"].round(0)  # ties
    x.iloc[20:40, 4] = 1.5  # a constant stretch
    return x


@pytest.mark.parametrize(
    ("e", "f"),
    [
        (X.ts_mean(X.col("x"), 5), lambda w: w.rolling(5).mean()),
        (X.ts_std(X.col("x"), 5), lambda w: w.rolling(5).std()),
        (X.rank(X.col("x")), lambda w: w.rank(axis=1, pct=True)),
        (X.ts_rank(X.col("x"), 7), lambda w: w.rolling(7).apply(lambda a: ((a < a[-1]).sum() + 0.5 * ((a == a[-1]).sum() + 1)) / len(a), raw=True)),
        (X.ts_argmax(X.col("x"), 6), lambda w: w.rolling(6).apply(np.argmax, raw=True)),
        (X.decay_linear(X.col("x"), 4), lambda w: w.rolling(4).apply(lambda a: np.dot(a, [0.4, 0.3, 0.2, 0.1]), raw=True)),
        (X.ts_skew(X.col("x"), 10), lambda w: w.rolling(10).skew()),
        (X.sma(X.col("x"), 7, 2), lambda w: w.ewm(alpha=2 / 7, adjust=False).mean()),
        (X.cs_zscore(X.col("x")), lambda w: w.sub(w.mean(axis=1), axis=0).div(w.std(axis=1), axis=0)),
    ],
)
def test_operators_equal_pandas(spark, wide, e, f):
    long = wide.rename_axis("date").reset_index().melt("date", var_name="code", value_name="x")
    long["sector"] = 0
    df = spark.createDataFrame(long).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = X.evaluate(df, {"y": e}).toPandas().pivot(index="date", columns="code", values="y").astype(float)
    want = f(wide)
    if e.op == "ts_skew":
        want["E"] = want["E"].mask(wide["E"].rolling(10).std() < 1e-9)  # a constant window has no skew
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_stages_follow_alternation_depth():
    a, b = X.rank(X.ts_mean(X.col("close"), 3)), X.rank(X.ts_std(X.col("close"), 5))
    stages = X.Compiler({"a": X.ts_corr(a, b, 10), "b": a + b}).stages()
    assert [k for k, _ in stages] == ["ts", "cs", "ts"]


def test_look_ahead_is_refused():
    with pytest.raises(ValueError):
        X.delta(X.col("close"), 0)


def test_later_rows_change_nothing_before(spark, wide):
    e = {"y": X.rank(X.ts_corr(X.col("x"), X.delay(X.col("x"), 1), 10))}
    long = wide.rename_axis("date").reset_index().melt("date", var_name="code", value_name="x")
    long["sector"] = 0
    broken = long.copy()
    broken.loc[broken["date"] >= "2024-02-20", "x"] = 1e10
    out = [X.evaluate(spark.createDataFrame(p).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))), e).where("date < '2024-02-20'").toPandas().sort_values(["date", "code"])["y"].astype(float).to_numpy() for p in (long, broken)]
    np.testing.assert_array_equal(*out)


def test_fifo_equals_queue(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"trade_id": range(n), "datetime": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 100, n), "h"), "symbol": rng.choice(list("ab"), n), "side": rng.choice(["buy", "sell"], n), "quantity": rng.integers(1, 20, n).astype(float), "price": rng.integers(1, 100, n).astype(float), "fee": 1.0})
    want = []
    for s, g in pdf.sort_values(["datetime", "trade_id"]).groupby("symbol"):
        lots = deque()
        for t in g.itertuples():
            if t.side == "buy":
                lots.append([t.trade_id, t.quantity])
                continue
            left = t.quantity
            while left and lots:
                m = min(left, lots[0][1])
                want.append((s, lots[0][0], t.trade_id, m))
                left -= m
                lots[0][1] -= m
                if not lots[0][1]:
                    lots.popleft()
    got = joins.fifo_lots(spark.createDataFrame(pdf)).select("symbol", "buy_id", "sell_id", "matched").collect()
    total = defaultdict(float)
    for r in got:
        total[tuple(r[:3])] += r[3]
    assert dict(total) == {w[:3]: w[3] for w in want}


def test_recursive_indicators_have_no_nan(spark):
    from lattiq.plans.panel import user_panel

    got = indicators.recursive(user_panel(spark, SF)).toPandas()
    assert got["rsi"].dropna().between(0, 100).all()


def test_china_rules_hold_shares_for_a_day(spark):
    pdf = pd.DataFrame({"run": 1, "date": pd.date_range("2024-01-01", periods=4), "code": "a", "open": 10.0, "close": 10.0, "weight": [0.5, 0.0, 0.0, 0.5]})
    got = simulation.simulate(spark.createDataFrame(pdf), "china_a", cash=100_000.0).toPandas()
    assert got["trades"].tolist() == [1, 0, 1, 1] or got["trades"].tolist() == [1, 1, 0, 1]


def test_permutation_is_replayable(spark):
    s, r = [1.0, -1.0, 1.0, 1.0], [0.1, -0.1, 0.1, 0.2]
    a, b = (validation.p_value(validation.permutation(spark, s, r, draws=50)).first() for _ in range(2))
    assert a == b and 0 < a["p_value"] <= 1


def test_option_prices_equal_the_closed_form(spark):
    import math

    from lattiq.operators import options

    cdf = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    rows = [(100.0, k, t, v, c) for k in (80.0, 100.0, 130.0) for t in (0.0, 0.1, 1.5) for v in (0.1, 0.4) for c in (True, False)]
    df = spark.createDataFrame(rows, "s double, k double, t double, v double, c boolean")
    got = options.black_scholes(df, "s", "k", "t", 0.02, "v", "c").collect()
    for r in got:
        sign = 1 if r.c else -1
        if r.t == 0:
            assert r.price == max(0.0, sign * (100 - r.k))
            continue
        d1 = (math.log(100 / r.k) + (0.02 + r.v**2 / 2) * r.t) / (r.v * math.sqrt(r.t))
        d2 = d1 - r.v * math.sqrt(r.t)
        assert abs(r.price - sign * (100 * cdf(sign * d1) - r.k * math.exp(-0.02 * r.t) * cdf(sign * d2))) < 1e-4
        assert abs(r.delta - sign * cdf(sign * d1)) < 1e-6
