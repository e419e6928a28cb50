"""The catalogue's plan: one scan and one exchange per source table, same values whether episodes are hot or not."""

import re
import time

import pytest

from oracle import compare
from tapeframe import jobs
from tapeframe.functions.scalars import round6_all
from tapeframe.operators.ordered import Tape
from tapeframe.plans import cross, names
from tapeframe.sources.adapters import Episodes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tapes(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tapes")
    e = Episodes(spark, FOLDER)
    out = []
    for name, tape in (("market", e.market), ("order", e.order), ("trade", e.trade)):
        tape.df.write.parquet(f"{folder}/{name}")
        out.append(Tape(spark.read.parquet(f"{folder}/{name}"), ties=tape.ties))
    return out


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("wanted", [names.BASE, [n for n in names.ALL if "large" not in n]], ids=["base", "all"])
def test_one_scan_and_one_exchange_per_table(tapes, wanted):
    cross.catalogue(*tapes, names.BASE[:3])
    start = time.perf_counter()
    plan = executed(cross.catalogue(*tapes, wanted))
    assert time.perf_counter() - start < 20  # not a measure, a guard against plans that grow by the factor
    assert len(re.findall("FileScan", plan)) == 3
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    assert "Exchange rangepartitioning" not in plan and "CartesianProduct" not in plan


def test_thresholds_travel_in_the_stream(spark):
    e = Episodes(spark, FOLDER)
    th = cross.size_thresholds(e.trade, e.months, None)
    large = [n for n in names.ALL if "large" in n]
    a = cross.catalogue(e.market, e.order, e.trade, large, sizes=cross.episode_thresholds(e.trade, e.months, th))
    b = cross.catalogue(e.market, e.order, cross.with_size_thresholds(e.trade, e.months, th), large)
    assert compare(round6_all(a).toPandas(), round6_all(b).toPandas()) == ""


def test_hot_episodes_have_the_same_factors(spark):
    e, tight = Episodes(spark, FOLDER), Episodes(spark, FOLDER, limit=88)
    assert tight.trade.hot is not None and tight.trade.hot.keys.count() < e.months.count()
    th = cross.size_thresholds(e.trade, e.months, None)
    sizes = cross.episode_thresholds(e.trade, e.months, th)
    wanted = ["t_imb_2s", "sig_txn", "t_autocorr_lag5", "burst5", "t_miss_max", "o_pxdiff7_std", "o_vol_max30", "m_rv60", "m_imb_q25", "imp_depth_5", "x_large_imb", "vwap_dev60"]
    got = cross.catalogue(tight.market, tight.order, tight.trade, wanted, sizes=sizes)
    assert compare(round6_all(got).toPandas(), round6_all(cross.catalogue(e.market, e.order, e.trade, wanted, sizes=sizes)).toPandas()) == ""


def test_episodes_without_trades_or_snapshots(spark):
    quotes = "ask_price_1 double, bid_price_1 double, ask_volume_1 double, bid_volume_1 double, ask_price_2 double, bid_price_2 double, ask_volume_2 double, bid_volume_2 double, transaction_avgprice double, transaction_volume double"
    row = (2.0, 1.0, 3.0, 4.0, 2.5, 0.5, 1.0, 2.0, None, None)
    market = Tape(spark.createDataFrame([(1, 10.0, *row), (1, 5.0, *row), (2, 7.0, *row)], f"sample_id long, s double, {quotes}"))
    event = "sample_id long, s double, price double, volume double, side int, seq long"
    trades = Tape(spark.createDataFrame([(1, 6.0, 1.5, 2.0, 0, 1), (1, 12.0, 1.5, 2.0, 1, 2), (3, 6.0, 1.5, 2.0, 0, 3)], event), ties=("seq",))
    orders = Tape(spark.createDataFrame([(2, 1.0, 1.5, 2.0, 0, 4, 0)], event + ", order_action int"), ties=("seq",))
    got = {r["sample_id"]: r for r in cross.catalogue(market, orders, trades, ["mid", "t_n", "t_vol", "burst5", "imp_depth_60", "spread_cross_frac", "o_n", "t_miss_max", "o_miss_max"]).collect()}
    assert sorted(got) == [1, 2]
    one, two = got[1].asDict(), got[2].asDict()
    assert (one["mid"], one["t_n"], one["t_vol"], one["burst5"], one["o_n"], one["t_miss_max"], one["o_miss_max"]) == (1.5, 2, 4.0, 0.5, None, 48, 61)
    assert one["imp_depth_60"] == pytest.approx(2 / 7) and one["spread_cross_frac"] == 0.0
    assert (two["t_n"], two["t_vol"], two["burst5"], two["imp_depth_60"], two["spread_cross_frac"], two["o_n"], two["t_miss_max"], two["o_miss_max"]) == (None, None, None, None, None, 1, 61, 59)
