"""The grid by arrays against the grid by windows, scans over arrays, and the shift match against sets."""

import random

import pytest
from pyspark.sql import functions as F

from tapeframe.operators import grid, quality, sequences, slots
from tapeframe.operators.joins import shift_match
from tapeframe.operators.screening import screen_channels
from tapeframe.sources.adapters import Episodes


@pytest.mark.parametrize("channels", ["flow_channels", "derived_channels"])
def test_both_grids_agree_on_every_channel(spark, channels):
    e = Episodes(spark, "/root/testdata/sf0.001")
    cells, scale = grid.flow_cells(e.order, e.trade, e.months), sequences.snapshot_index(e.market)
    a, b = getattr(grid, channels)(cells, scale), getattr(slots, channels)(cells, scale)
    assert a.schema.names == b.schema.names
    for row in quality.relative_difference(a, b, ["sample_id", "bin"], a.columns[2:]).collect():
        assert row.unmatched == 0 and row.worst < 1e-9, row


def test_array_plan_has_no_window(spark):
    e = Episodes(spark, "/root/testdata/sf0.001")
    cells, scale = e.months.select("sample_id"), e.months.select("sample_id", F.lit(1.0).alias("U_s"))
    raw = "nb ns cb cs opxv ovol ocnt obcnt tb ts tvol tpxv tcnt tbcnt t_maxv tsec_max tsec_min big_buy big_sell opx_std".split()
    cells = cells.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("bin"), *[F.lit(0.0).alias(c) for c in raw])
    for plan in (slots.flow_channels, slots.derived_channels):
        assert "Window" not in plan(cells, scale)._jdf.queryExecution().executedPlan().toString()


def test_scan_and_last_slots(spark):
    df = spark.createDataFrame([([3, -1, 4],), ([],)], "x array<int>")
    sums = slots.scan(F.col("x"), F.lit(0), lambda a, x: a + x)
    lasts = F.transform("x", lambda _, i: slots.last_slots(F.col("x"), i, 2))
    got = [tuple(r) for r in df.select(sums, lasts).collect()]
    assert got == [([0, 3, 2, 6], [[3], [3, -1], [-1, 4]]), ([0], [])]


def test_correlation_needs_a_full_window_and_spread(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)],), ([(1.0, 2.0), (2.0, 4.0)],), ([(1.0, 2.0)] * 3,)], "p array<struct<x double, y double>>")
    got = [r[0] for r in df.select(slots.correlation(F.col("p"), 3)).collect()]
    assert got[0] == pytest.approx(0.993399, abs=1e-6) and got[1:] == [0.0, 0.0]


def test_shift_match_equals_sets(spark):
    rng = random.Random(5)
    event = lambda: (rng.randrange(3), rng.randrange(40) / 10, rng.choice([1.5, 2.5, None]), rng.randrange(2))
    a, b = [event() for _ in range(200)], [event() for _ in range(150)]
    shape = "sample_id long, s double, price double, side int"
    shifts = [0.5, 1.0, 2.5, 9.0]
    got = {
        (r.sample_id, r.d): (r.events, r.matched)
        for r in shift_match(spark.createDataFrame(a, shape), spark.createDataFrame(b, shape), "sample_id", "s", ["price", "side"], shifts, 0.1).collect()
    }
    want = {}
    for k in range(3):
        mine, theirs = ({(round(s * 10), p, v) for i, s, p, v in rows if i == k} for rows in (a, b))
        for d in shifts:
            old = [e for e in mine if e[0] >= round(d * 10)]
            if old:  # events without a price are counted and match nothing
                want[k, d] = len(old), sum(p is not None and (t - round(d * 10), p, v) in theirs for t, p, v in old)
    assert got == want


def test_channels_are_screened_by_the_last_bins_too(spark):
    """Target 1, -1, 1, -1 ...: `late` follows it in its last bins only, `flat` is constant, `noise` has cosine 0 in both."""
    rows = [(m, t, 0.0 if i % 2 else 1e-12, t, 2.0, 2.0, float(i < 2), float(i < 2), t, t) for m in (0, 1) for i, t in enumerate([1.0, -1.0] * 4)]
    names = ["month", "target", "late_full", "late_last2", "flat_full", "flat_last2", "noise_full", "noise_last2", "all_full", "all_last2"]
    df = spark.createDataFrame(rows, names)
    got = {r.factor: r for r in screen_channels(df, ["flat", "noise", "all"], dead=0.02).collect()}
    assert (got["flat"].verdict, got["noise"].verdict, got["all"].verdict) == ("dead", "drop", "keep")
    assert got["all"].pos_frac == 1.0 and got["noise"].nonzero == 0.25 and got["noise"].cos_full == 0.0
    late = screen_channels(df.withColumn("late_full", df.noise_full), ["late"], dead=0.02).first()
    assert (late.verdict, late.cos_last, late.cos_full) == ("keep", 1.0, 0.0)
    assert screen_channels(df, ["late"]).first().verdict == "dead"  # rests below `tiny` are no values
