"""Factors that are easiest to state step by step, against pandas; missing values of accounts, news and boards."""

import sys
from datetime import date, datetime
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lattiq.functions.expr import Compiler  # noqa: E402
from lattiq.operators import sentiment  # noqa: E402
from lattiq.plans import fundamental, short_horizon  # noqa: E402


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(7)
    out = []
    for code in "ABC":
        close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, 70)))
        open_ = close * np.exp(rng.normal(0, 0.01, 70))
        high, low = np.maximum(open_, close) * (1 + rng.uniform(0, 0.02, 70)), np.minimum(open_, close) * (1 - rng.uniform(0, 0.02, 70))
        volume = rng.integers(100, 1000, 70).astype(float)
        out.append(pd.DataFrame({"date": pd.date_range("2024-01-01", periods=70).date, "code": code, "open": open_, "high": high, "low": low, "close": close, "volume": volume, "amount": volume * close, "vwap": (high + low + close) / 3, "sector": 0}))
    return pd.concat(out, ignore_index=True)


def by_hand(k: int, b: pd.DataFrame) -> np.ndarray:
    """Values of a factor for one code, a row at a time."""
    o, h, low, c, n = (b[x].to_numpy() for x in ("open", "high", "low", "close", "close"))
    out = np.full(len(n), np.nan)
    for t in range(len(n)):
        if k == 143:
            out[t] = np.prod([max(c[i] / c[i - 1], 1.0) for i in range(1, t + 1)]) if t else 1.0
        if k == 50 and t >= 11:  # the first bar has no move and counts as none
            moves = [(h[i] + low[i] - h[i - 1] - low[i - 1], max(abs(h[i] - h[i - 1]), abs(low[i] - low[i - 1]))) for i in range(max(t - 11, 1), t + 1)]
            up, down = sum(m for s, m in moves if s > 0), sum(m for s, m in moves if s < 0)
            out[t] = (up - down) / (up + down)
        if k == 137 and t:
            a, d, g, p = abs(h[t] - c[t - 1]), abs(low[t] - c[t - 1]), abs(h[t] - low[t - 1]), abs(c[t - 1] - o[t - 1])
            widest = a + d / 2 + p / 4 if a > d and a > g else d + a / 2 + p / 4 if d > g and d > a else g + p / 4
            out[t] = 16 * (c[t] - c[t - 1] + (c[t] - o[t]) / 2 + c[t - 1] - o[t - 1]) / widest * max(a, d)
        if k == 187 and t >= 20:
            out[t] = sum(max(h[i] - o[i], o[i] - o[i - 1]) for i in range(t - 19, t + 1) if o[i] > o[i - 1])
        if k == 172 and t >= 19:
            dx = []
            for e in range(t - 5, t + 1):
                steps = [(h[i] - h[i - 1], low[i - 1] - low[i]) for i in range(e - 13, e + 1)]
                plus, minus = sum(f for r, f in steps if f > 0 and f > r), sum(r for r, f in steps if r > 0 and r > f)
                dx.append(abs(plus - minus) / (plus + minus) * 100)
            out[t] = np.mean(dx)
    return out


@pytest.mark.parametrize("k", [50, 137, 143, 172, 187])
def test_short_horizon_factor_equals_a_loop(spark, bars, k):
    name = f"short_{k:03d}"
    got = Compiler({name: short_horizon.factors()[name]}).apply(spark.createDataFrame(bars)).toPandas().sort_values(["code", "date"])
    for code, part in got.groupby("code"):
        np.testing.assert_allclose(part[name].to_numpy(dtype=float), by_hand(k, bars[bars.code == code]), rtol=1e-9, equal_nan=True)


def test_the_short_horizon_family_is_complete():
    assert list(short_horizon.factors()) == [f"short_{k:03d}" for k in range(1, 192)]


def test_fundamentals_with_missing_accounts(spark):
    rows = [(date(2024, 1, d), c, 10.0, roe, acc, 5.0) for d, c, roe, acc in [(1, "A", 0.1, 1.0), (1, "B", 0.2, None), (1, "C", 0.3, 3.0), (2, "A", 0.4, 1.0), (2, "B", None, 1.0), (2, "C", 0.15, -2.0)]]
    panel = spark.createDataFrame(rows, "date date, code string, close double, roe double, accruals double, bvps double")
    got = {(r.date.day, r.code): r for r in Compiler(fundamental.fundamentals()).apply(panel).collect()}
    assert [got[1, c].quality_roe_pct for c in "ABC"] == pytest.approx([1 / 3, 2 / 3, 1])
    assert [got[2, c].quality_roe_pct for c in "ABC"] == [0.5, 0.5, 0.5]  # two known values are too few
    assert [got[2, c].quality_roe_change for c in "ABC"] == pytest.approx([1.0, 0.0, -0.5])  # the first is held at 1
    assert [got[1, c].quality_roe_change for c in "ABC"] == [0, 0, 0]
    assert got[1, "B"].quality_accrual is None and got[1, "C"].quality_accrual == -3 and got[1, "A"].value_book_to_price == 0.5


def test_news_scores_take_the_latest_articles(spark):
    rows = [("A", datetime(2024, 1, 1), i, 1.0 if i >= 10 else -1.0, f"s{i % 7}") for i in range(30)] + [("B", datetime(2024, 1, 2), 1, None, ""), ("B", datetime(2024, 1, 2), 2, 0.5, None)]
    got = {r.code: r for r in sentiment.news_scores(spark.createDataFrame(rows, "code string, at timestamp, article_id int, score double, source string")).collect()}
    assert got["A"].score == 1 and got["A"].heat == pytest.approx(np.log1p(30) * 1.5) and got["A"].divergence == pytest.approx(np.std([-1.0] * 10 + [1.0] * 20))
    assert got["B"].score == 0.25 and got["B"].heat == pytest.approx(np.log1p(2)) and got["B"].divergence == 0


def test_boards(spark):
    rows = [("A", date(2024, 1, d), d, 5.0, 10.0, 4.0, 1) for d in range(1, 4)] + [("B", date(2024, 1, 3), 9, None, None, None, None)]
    board = spark.createDataFrame(rows, "code string, date date, report_id int, net double, deal double, bought double, institutions int")
    got = {r.code: r.board for r in sentiment.board_scores(board, days=2).collect()}
    assert got == pytest.approx({"A": 0.5 * np.log1p(2), "B": 0.0})
    assert {r.code: r.seats for r in sentiment.seat_scores(board).collect()} == pytest.approx({"A": np.tanh(1.35), "B": 0.0})
    assert sentiment.board_scores(board.where("code = 'Z'")).count() == 0 and sentiment.seat_scores(board.where("code = 'Z'")).count() == 0
