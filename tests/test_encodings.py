"""Encodings against the definition value by value, and their sums in one pass with them."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import folds
from tapeframe.operators.encodings import totals

CASES = [(x, e) for x in (None, -1.0, 0.0, 0.3, 1.0, 2.5, 9.0, math.nan) for e in ([0.0, 1.0], [0.0, 1.0, 3.0], [-2.0, 0.0, 0.5, 4.0, 5.0], [1.0], [0.0, 0.0, 1.0], None)]


def by_hand(x, edges):
    if edges is None:
        return None
    last, out = len(edges) - 2, []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        t = None if x is None or hi == lo else (x - lo) / (hi - lo)
        if i > 0:  # as greatest and least: nulls give way, NaN is the largest
            t = 0.0 if t is None else t if math.isnan(t) else max(t, 0.0)
        if i < last:
            t = 1.0 if t is None or math.isnan(t) else min(t, 1.0)
        out.append(t)
    return out


def test_encodings_and_their_sums(spark):
    df = spark.createDataFrame([(i, x, e) for i, (x, e) in enumerate(CASES)], "i int, x double, e array<double>")
    p = folds.piecewise_linear(F.col("x"), F.col("e"))
    got = {r.i: r for r in df.select("i", p.alias("p"), totals(p).alias("t")).collect()}
    for i, (x, edges) in enumerate(CASES):
        want, t = by_hand(x, edges), got[i].t
        if want is None:
            assert got[i].p is None and (t.bins, t.total, t.moment) == (None, None, None)
            continue
        assert len(got[i].p) == len(want) == t.bins
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b, nan_ok=True)) for a, b in zip(got[i].p, want))
        if None in want:
            assert t.total is None and t.moment is None
        else:
            assert t.total == pytest.approx(sum(want), nan_ok=True) and t.moment == pytest.approx(sum(k * v for k, v in enumerate(want, 1)), nan_ok=True)


def test_encodings_are_made_in_batches(spark):
    df = spark.createDataFrame([(0.5, [0.0, 1.0])], "x double, e array<double>")
    plan = df.select(totals(folds.piecewise_linear(F.col("x"), F.col("e"))).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("ArrowEvalPython", plan)) == 1 and "lambda" not in plan
