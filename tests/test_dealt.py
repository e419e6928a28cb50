"""Plans that deal events by their number: as many tasks as the rows ask for, the same values."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from oracle import compare
from tapeframe.functions.scalars import round6_all
from tapeframe.operators import grid, joins, ordered
from tapeframe.operators.ordered import Tape, dealt
from tapeframe.plans import cross

QUOTES = "ask_price_1 double, bid_price_1 double, ask_volume_1 double, bid_volume_1 double, ask_price_2 double, bid_price_2 double, ask_volume_2 double, bid_volume_2 double, transaction_avgprice double, transaction_volume double"
EVENT = "sample_id long, s double, price double, volume double, side int, seq long"


def tapes(spark, rows):
    """Episode 1: prices 1, 2, 4, 8, 16, 32 in seconds 0, 1, 3, 4, 10, 20, the newest second with two trades."""
    clock = [(0.2, 1.0), (0.7, 1.0), (1.5, 2.0), (3.0, 4.0), (4.9, 8.0), (10.0, 16.0), (20.0, 32.0)]
    events = [(k, s, p * k, 2.0, i % 2, i) for k in (1, 2, 3) for i, (s, p) in enumerate(clock)]
    books = [(k, 10.0 * i, 2.0 + i, 1.0, 3.0, 4.0 + i, 2.5, 0.5, 1.0, 2.0, None, None) for k in (1, 2, 3) for i in range(4)]
    trades = Tape(spark.createDataFrame(events, EVENT), ties=("seq",), rows=rows)
    orders = Tape(spark.createDataFrame([(*r, r[-1] % 2) for r in events], EVENT + ", order_action int"), ties=("seq",), rows=rows)
    return Tape(spark.createDataFrame(books, f"sample_id long, s double, {QUOTES}")), orders, trades


def test_tasks_grow_with_the_events(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 2)
    df = spark.range(100).withColumnRenamed("id", "sample_id")
    assert dealt(df, "sample_id", 41).rdd.getNumPartitions() == 21
    assert dealt(df, "sample_id", 1).count() == dealt(df, "sample_id", None).count() == 100


def test_catalogue_collects_no_rows_in_its_wide_aggregate(spark):
    plan = cross.catalogue(*tapes(spark, None), ["mid", "m_imb_med", "m_imb_q25", "t_imb", "t_miss_max", "burst5", "o_vol_max30"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_second_and_quantile_factors(spark, monkeypatch):
    wanted = ["t_has_data_15", "t_miss_max", "t_vol_max30", "burst5", "t_autocorr_lag1", "t_autocorr_lag5", "o_miss_max", "m_imb_med", "m_imb_q25", "m_sp_q75"]
    plain = cross.catalogue(*tapes(spark, None), wanted)
    one = plain.where("sample_id = 1").first().asDict()
    assert (one["t_has_data_15"], one["t_miss_max"], one["t_vol_max30"], one["o_miss_max"]) == (5, 40, 4.0, 40)
    assert one["burst5"] == 5 / 7 and one["m_sp_q75"] == 3.0
    px = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
    dev = [x - sum(px) / 6 for x in px]
    assert abs(one["t_autocorr_lag5"] - dev[5] * dev[0] / sum(d * d for d in dev)) < 1e-12
    imb = sorted((4.0 + i - 3.0) / (7.0 + i) for i in range(4))
    assert abs(one["m_imb_med"] - (imb[1] + imb[2]) / 2) < 1e-12 and one["m_imb_q25"] == imb[1]
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 2)
    assert compare(round6_all(cross.catalogue(*tapes(spark, 21), wanted)).toPandas(), round6_all(plain).toPandas()) == ""


def test_cells_of_dealt_events(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 2)
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "sample_id long")
    (_, o, t), (_, o2, t2) = tapes(spark, 21), tapes(spark, None)
    cells = grid.flow_cells(o, t, ids)
    assert cells.rdd.getNumPartitions() == 11
    assert "hashpartitioning(sample_id#" in (plan := cells._jdf.queryExecution().executedPlan().toString()) and ", bin#" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", plan))
    assert compare(round6_all(cells).toPandas(), round6_all(grid.flow_cells(o2, t2, ids)).toPandas()) == ""
    assert cells.count() == 240


def test_state_match_copies_rows_after_dealing_them(spark, monkeypatch):
    market = tapes(spark, None)[0]
    later = market.map(lambda df: df.withColumn("sample_id", F.col("sample_id") - 1))
    shifts = [0.0, 10.0, 15.0]
    plain = joins.state_match(market, later, ["ask_volume_1", "bid_volume_1"], shifts)
    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 2)
    got = joins.state_match(replace(market, rows=12), replace(later, rows=12), ["ask_volume_1", "bid_volume_1"], shifts)
    exchanges = re.findall("Exchange hashpartitioning.*", got._jdf.queryExecution().executedPlan().toString())
    assert len(exchanges) == 4 and all("REPARTITION_BY_NUM" in x for x in exchanges)  # rows, their range, states above and below
    assert compare(got.toPandas(), plain.toPandas()) == ""
    assert {(r["sample_id"], r["d"]): (r["rows"], r["matched"]) for r in got.collect()}[1, 0.0] == (4, 4)
