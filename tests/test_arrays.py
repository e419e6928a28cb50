"""Expressions and aggregates on arrays say what Spark says, nulls, NaN and zeros included; the catalogue's rows meet no window of Spark."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import compare
from tapeframe.functions.scalars import decay, div, imbalance
from tapeframe.operators import arrays
from tapeframe.operators.arrays import Rows
from tapeframe.operators.parts import Parts, Terms
from tapeframe.plans import cross, names
from test_dealt import tapes
from test_parts import factors

NUMBERS = [None, 0.0, 1.0, -2.0, 7.5, math.nan, 1.0, None, 3.0]
ROWS = [(k, x, y, i % 3 == 0 if i % 4 else None, i) for k in (1, 2) for i, (x, y) in enumerate((x, y) for x in NUMBERS for y in NUMBERS[:6])]


def of_rows(rows, names, starts):
    columns = {}
    for n, values in zip(names, zip(*rows)):
        kind = bool if isinstance(next(v for v in values if v is not None), bool) else float
        columns[n] = (np.array([kind(0) if v is None else kind(v) for v in values]), np.array([v is not None for v in values]))
    return Rows(columns, np.array(starts), len(rows), {})


def test_expressions_follow_spark(spark):
    x, y, b = F.col("x"), F.col("y"), F.col("b")
    exprs = {
        "lt": x < y, "le": x <= y, "gt": x > y, "ge": x >= y, "eq": x == y, "and": (x > 0) & b, "or": (x > 0) | b, "not": ~b, "there": x.isNotNull(),
        "if": F.when(x > 0, y), "else": F.when(x > 0, y).when(b, x).otherwise(F.lit(4.0)), "div": div(x, y), "imb": imbalance(x, y), "decay": decay("x", 30),
        "log": F.log1p(x), "pow": F.pow("x", F.lit(2.0)), "some": F.coalesce(x, y, F.lit(9.0)), "abs": F.abs(x - y), "cast": b.cast("double"), "half": x / 2,
    }
    df = spark.createDataFrame(ROWS, "k long, x double, y double, b boolean, i int").orderBy("k", "i")
    want = df.select(*[e.alias(n) for n, e in exprs.items()]).collect()
    rows = of_rows(ROWS, ("k", "x", "y", "b", "i"), [0, len(ROWS) // 2])
    for n, e in exprs.items():
        v, m = rows.value(arrays.compiled(e))
        v, m = np.broadcast_to(v, rows.size), np.ones(rows.size, bool) if m is None else m
        got = [float(a) if ok else None for a, ok in zip(v, m)]
        for g, w in zip(got, (r[n] for r in want), strict=True):
            assert (g is None) == (w is None) and (g is None or g == pytest.approx(float(w), nan_ok=True)), n


def test_aggregates_by_group_follow_spark(spark):
    data = [(k, None if (i * k) % 5 == 3 else float(i * i % 7), i) for k, n in ((1, 9), (2, 1), (3, 4), (4, 30)) for i in range(n)] + [(5, None, 0), (5, None, 1), (6, 2.5, 0), (6, 2.5, 1)]
    df = spark.createDataFrame([(k, 0, x, i) for k, x, i in data], "k long, who int, x double, i int")
    terms = Terms("_of_a")
    p = Parts([terms], factors(terms))
    want = p.aggregate(df.select("k", *p.columns(0)), "k", p.handed(0))
    keys, starts = np.unique([k for k, *_ in data], return_index=True)
    rows = of_rows(data, ("k", "x", "i"), starts)
    narrow = []
    for part in p.trees(0).partial(rows):
        none = (np.zeros(len(keys)), np.zeros(len(keys), bool))
        columns = {c: [v.item() if ok else None for v, ok in zip(x, np.ones(len(keys), bool) if m is None else m)] for c, (x, m) in ((c, v or none) for c, v in part.items())}
        narrow += [(int(k), *[columns[c][j] for c in columns]) for j, k in enumerate(keys)]
    got = p.side_by_side(spark.createDataFrame(narrow, f"k long, {p.schema()}"), "k")
    rounded = lambda d: d.select("k", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in d.columns if c != "k"]).toPandas()
    assert compare(rounded(got), rounded(want)) == ""


def test_batches_are_cut_between_groups(monkeypatch):
    monkeypatch.setattr(arrays, "CHUNK", 4)
    keys = [None, None, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5]
    table = pa.table({"k": pa.array(keys, pa.int64()), "i": range(len(keys))})
    pieces = [t.to_pylist() for t in arrays.by_group(iter(table.to_batches(max_chunksize=3)), "k")]
    assert [r["i"] for p in pieces for r in p] == list(range(len(keys)))
    assert len(pieces) > 2 and sum(len({r["k"] for r in p}) for p in pieces) == 6


def test_rows_of_the_catalogue_meet_no_window(spark):
    market, orders, trades = tapes(spark, None)
    plan = cross.catalogue(market, orders, trades, [n for n in names.ALL if "large" not in n])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    assert len(re.findall("MapInArrow", plan)) == 1 and len(re.findall(r"\bSort \[", plan)) == 1


def test_snapshots_are_found_at_or_before_a_trade(spark):
    quotes = "ask_price_1 double, bid_price_1 double, ask_volume_1 double, bid_volume_1 double"
    book = lambda k, s, i, volume: (k, s, i, 2.0, 1.0, volume, 0.0)
    from tapeframe.operators.ordered import Tape

    market = Tape(spark.createDataFrame([book(1, 10.0, 0, 1.0), book(1, 10.0, 1, 2.0), book(1, 5.0, 0, 4.0), book(2, None, 0, 8.0), book(2, 3.0, 0, 16.0)], f"sample_id long, s double, seq long, {quotes}"), ties=("seq",))
    event = "sample_id long, s double, price double, volume double, side int, seq long"
    trades = Tape(spark.createDataFrame([(1, 10.0, 1.5, 1.0, 0, 0), (1, 7.0, 1.5, 1.0, 0, 1), (1, 5.0, 1.5, 1.0, 0, 2), (1, 11.0, 1.5, 1.0, 0, 3), (2, None, 1.5, 1.0, 0, 0), (2, 1.0, 1.5, 1.0, 0, 1)], event), ties=("seq",))
    got = {r["sample_id"]: r["imp_depth_60"] for r in cross.catalogue(market, trades, trades, ["imp_depth_60"]).collect()}
    assert got == {1: pytest.approx(1 + 1 + 1 / 4), 2: pytest.approx(1 / 8 + 1 / 16)}
