"""Prices, quantities and volumes of zero: no query divides by them, and the SQL that makes such ratios NULL agrees."""

import pytest
from zeros import sorted_rows, sql_rows, zero_tables

from lattiq.queries import ORACLES, QUERIES

COMPARED = ["intraday_daily_factors", "intraday_blend", "intraday_money_flow", "intraday_followed_peaks", "daily_bar_factors", "panel_brand_daily", "panel_user_daily", "panel_checked_prices", "research_tick_structure"]
RUN = ["intraday_day_shapes", "zoo_fundamental", "chip_structure", "rules_china_futures", "rules_global_futures", "strategy_allocation", "backtest_simulation", "zoo_window_20", "market_states"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return zero_tables("/root/testdata/sf0.001", str(tmp_path_factory.mktemp("zeros")))


@pytest.mark.parametrize("name", COMPARED)
def test_zeros_equal_sql(spark, folder, name):
    got, want = sorted_rows(QUERIES[name](spark, folder).toPandas()), sorted_rows(sql_rows(ORACLES[name], folder))
    assert got == want, [p for p in zip(got, want, strict=False) if p[0] != p[1]][:2]


@pytest.mark.parametrize("name", RUN)
def test_zeros_run(spark, folder, name):
    assert QUERIES[name](spark, folder).toPandas() is not None
