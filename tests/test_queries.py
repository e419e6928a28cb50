"""Every registered query with SQL against DuckDB on the smallest tables; a selection again with a row
limit so low that episodes, periods and the whole table are hot groups."""

import pytest

from oracle import compare, duck
from tapeframe.checks.registry import PLANS, SQL
from tapeframe.sources.adapters import Episodes

FOLDER = "/root/testdata/sf0.001"
LIMITED = ["f_base_trade", "f_ext3_book", "f_base_depth", "q7_trade_events", "q5_second_aggregates", "j7_nearest_present",
           "a18_auc", "dq3_gap_report", "w13_equal_frequency_bins", "w7_fill", "w12_rank_by_period", "e6_composites", "e7_modulation", "e11_cause_table", "p3_fold_statistics"]


@pytest.fixture(scope="session")
def con():
    return duck(FOLDER)


@pytest.fixture(scope="session")
def plain(spark):
    return Episodes(spark, FOLDER)


@pytest.fixture(scope="session")
def tight(spark):
    return Episodes(spark, FOLDER, limit=60)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, plain, con):
    assert compare(PLANS[name](plain).toPandas(), con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", LIMITED)
def test_equals_sql_with_hot_groups(name, tight, con):
    assert compare(PLANS[name](tight).toPandas(), con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs_without_sql(name, plain):
    assert PLANS[name](plain).count() > 0
