"""The batch builds from files: same values as the plans on the adapter views, periods replaced one by one."""

import re

import pytest
from pyspark.sql import functions as F

from oracle import compare
from tapeframe import jobs, schema
from tapeframe.checks.factor_checks import full_catalogue
from tapeframe.checks.registry import PLANS
from tapeframe.functions.scalars import round6_all
from tapeframe.sources.adapters import Episodes


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    e = Episodes(spark, "/root/testdata/sf0.001")

    def event(tape, expected, *order):
        df = tape.df.withColumnRenamed("s", "seconds_before_predict")
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in expected.fields], *tape.ties)
        # one file, episodes oldest first, equal stamps in key order: the file position is the tie-break
        return df.coalesce(1).sortWithinPartitions("sample_id", F.desc("seconds_before_predict"), *tape.ties).drop(*tape.ties)

    for split in ("train", "test"):
        event(e.trade, schema.TRADE).write.parquet(f"{folder}/{split}/transaction.parquet")
        event(e.order, schema.ORDER).write.parquet(f"{folder}/{split}/order.parquet")
        event(e.market, schema.MARKET).write.parquet(f"{folder}/{split}/market.parquet")
    e.label.select(*[F.col(f.name).cast(f.dataType) for f in schema.LABEL.fields]).write.parquet(f"{folder}/train/label.parquet")
    return str(folder)


def test_factor_build_equals_the_plans(spark, root, tmp_path):
    e = Episodes(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "factors")
    wanted = ["t_imb_2s", "sig_txn", "o_pxdiff7_std", "ofi_norm", "m_rv60", "imp_depth_60", "t_large_buy", "x_large_imb_15", "burst5"]
    jobs.build_factors(jobs.Data(spark, root, "train"), out, wanted)
    got = round6_all(spark.read.parquet(out).select("sample_id", *wanted)).toPandas()
    assert compare(got, round6_all(full_catalogue(e, wanted)).toPandas()) == ""
    before = spark.read.parquet(out).groupBy("month").count().collect()
    jobs.build_factors(jobs.Data(spark, root, "train", [3]), out, wanted)
    assert sorted(spark.read.parquet(out).groupBy("month").count().collect()) == sorted(before)


def test_test_split_uses_the_whole_table(spark, root):
    e = Episodes(spark, "/root/testdata/sf0.001")
    large = ["t_large_buy", "t_large_sell", "x_large_imb"]
    got = jobs.factor_table(jobs.Data(spark, root, "test"), large).toPandas()
    want = PLANS["f_large_trades_overall"](e).select("sample_id", *large).toPandas()
    assert compare(round6_all(spark.createDataFrame(got)).toPandas(), want) == ""


def test_sequence_build_equals_the_plans(spark, root, tmp_path):
    e = Episodes(spark, "/root/testdata/sf0.001")
    out = str(tmp_path / "sequences")
    jobs.build_sequences(jobs.Data(spark, root, "train"), out)
    snap = round6_all(spark.read.parquet(f"{out}/snapshots").drop("month")).toPandas()
    assert compare(snap, PLANS["q1_snapshot_sequence"](e).toPandas()) == ""
    flow = PLANS["q3_flow_grid"](e)
    got = round6_all(spark.read.parquet(f"{out}/flow").select(*flow.columns)).toPandas()
    assert compare(got, flow.toPandas()) == ""
    trades = round6_all(spark.read.parquet(f"{out}/trade_events").drop("month").where("n_ev > 0")).toPandas()
    assert compare(trades, PLANS["q7_trade_events"](e).where("n_ev > 0").toPandas()) == ""


def test_misordered_and_split_episodes_are_refused(spark, tmp_path):
    """The builds count on file order, so they look before they start."""
    row = lambda k, s: (k, float(s), 1.0, 1.0, 0)
    event = schema.TRADE
    good = [row(1, 5), row(1, 5), row(1, 2), row(2, 9), row(2, 1)]
    for name, parts, fault in (
        ("good", [good], None),
        ("misordered", [[row(1, 2), row(1, 5), *good[3:]]], "1 rows"),
        ("split", [good[:1] + good[3:], good[1:3]], "more than one file"),
    ):
        path = f"{tmp_path}/{name}/test/transaction.parquet"
        for part in parts:
            spark.createDataFrame(part, event).coalesce(1).write.mode("append").parquet(path)
        data = jobs.Data(spark, f"{tmp_path}/{name}", "test")
        if fault is None:
            rows = data.tape("transaction").ordered(newest=False).orderBy("sample_id", "idx").collect()
            assert [(r.sample_id, r.s, r.seq) for r in rows] == [(1, 5.0, 0), (1, 5.0, 1), (1, 2.0, 2), (2, 9.0, 3), (2, 1.0, 4)]
        else:
            with pytest.raises(ValueError, match=fault):
                data.tape("transaction")
            assert jobs.Data(spark, f"{tmp_path}/{name}", "test", trusted=True).tape("transaction").df.count() == sum(map(len, parts))


def test_event_tables_by_month_are_pruned_and_give_the_same_factors(spark, root, tmp_path):
    """A layout of its own copy: only the wanted month's folder is read, place and values stay."""
    copy, wanted = f"{tmp_path}/data", ["t_imb_2s", "ofi_norm", "m_rv60", "t_large_buy", "x_large_imb_15"]
    for name in ("label", *jobs.EVENTS):
        spark.read.parquet(f"{root}/train/{name}.parquet").coalesce(1).write.parquet(f"{copy}/train/{name}.parquet")
    before = jobs.factor_table(jobs.Data(spark, copy, "train", [3]), wanted).toPandas()
    was = jobs.Data(spark, copy, "train", [2, 3]).tape("transaction").df.toPandas()
    jobs.Data(spark, copy, "train").lay_out()
    data = jobs.Data(spark, copy, "train", [2, 3])
    tape = data.tape("transaction")
    plan = tape.df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*month#\d+ IN \(2,3\)", plan) and "Join" not in plan
    assert compare(tape.df.toPandas(), was) == ""
    again = jobs.factor_table(jobs.Data(spark, copy, "train", [3]), wanted).toPandas()
    assert len(again) and compare(round6_all(spark.createDataFrame(again)).toPandas(), round6_all(spark.createDataFrame(before)).toPandas()) == ""
    jobs.Data(spark, copy, "train", [3]).lay_out()
    assert compare(jobs.Data(spark, copy, "train", [2, 3]).tape("transaction").df.toPandas(), was) == ""
    with pytest.raises(ValueError, match="training split"):
        jobs.Data(spark, root, "test").lay_out()
