"""Data-quality reports. Each is one or two aggregations; reports over all rows go through value counts,
never through a sort of the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import div
from .ordered import Hot, Tape, ordered
from .quantiles import quantiles

NOMINAL_GAP, TAIL_SECONDS = 3.0, 60.0
# fixed values: gap classes of the cadence report, seconds
GAP_EDGES = (0.0, 3.5, 4.5, 6.0, 10.0, 30.0, 60.0, 1e9)


def table_profile(tape: Tape, *, hot: Hot | None) -> DataFrame:
    """(stat, rows, episodes, rows_per_episode, min, max, mean, median) of per-episode first clock, last
    clock and row count. `hot` is the all-episodes group."""
    k, s = tape.key, tape.clock
    per = tape.df.groupBy(k).agg(
        F.min(s).alias("clock_min"), F.max(s).alias("clock_max"), F.count(F.lit(1)).cast("double").alias("row_count")
    ).withColumn("_all", F.lit(0))
    names = ["clock_min", "clock_max", "row_count"]
    med = quantiles(per, ["_all"], {f"m_{c}": (c, 0.5, "linear") for c in names}, hot=hot, limit=tape.limit)
    wide = per.groupBy("_all").agg(
        F.sum("row_count").cast("long").alias("rows"), F.count(F.lit(1)).alias("episodes"),
        *[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))],
    ).join(med, "_all")
    stats = F.explode(F.array(*[
        F.struct(F.lit(c).alias("stat"), F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"),
                 F.col(f"avg_{c}").alias("mean"), F.col(f"m_{c}").alias("median"))
        for c in names
    ]))
    return wide.select("rows", "episodes", div("rows", "episodes").alias("rows_per_episode"), stats.alias("_s")).select(
        "rows", "episodes", "rows_per_episode", "_s.*"
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, type, rows, nulls, distinct) per column; one pass per column over its own values."""
    types = dict(df.dtypes)
    parts = [
        df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.sum("_n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("_n"))), F.lit(0)).alias("nulls"), F.count(c).alias("distinct"),
        )
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def target_profile(label: DataFrame) -> DataFrame:
    """Episodes, zero share and number of distinct targets."""
    per_value = label.groupBy("target").agg(F.count(F.lit(1)).alias("_n"))
    zeros = F.coalesce(F.sum(F.when(F.col("target") == 0, F.col("_n"))), F.lit(0))
    return per_value.agg(F.sum("_n").alias("episodes"), div(zeros, F.sum("_n")).alias("zero_share"), F.count("target").alias("distinct"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most common values, smaller value first at equal counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column)).limit(k)


def period_stats(label: DataFrame, value: str = "target", period: str = "month") -> DataFrame:
    return label.groupBy(period).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[int]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def gaps(tape: Tape, *, file_order: str | None = None) -> DataFrame:
    """(episode, s, prev, gap): time from the row before, oldest first, or in file order when `file_order`
    names the row number (then a negative gap is an inversion)."""
    order = [F.col(file_order).asc()] if file_order else tape.oldest_first()
    cols = list(dict.fromkeys([tape.key, tape.clock, *tape.ties, *([file_order] if file_order else [])]))
    df = ordered(tape.df.select(*cols), [tape.key], order, hot=tape.hot, limit=tape.limit, idx="pos", total="n", lags={"prev": (tape.clock, 1)})
    return df.withColumn("gap", F.col("prev") - F.col(tape.clock))


def gap_report(tape: Tape, *, hot: Hot | None, edges: Sequence[float] = GAP_EDGES, file_order: str | None = None) -> DataFrame:
    """One row: gaps, mean, q50/q90/q99/q999, max, inversions, duplicate stamps, share per gap class."""
    g = gaps(tape, file_order=file_order).where(F.col("gap").isNotNull()).select(F.lit(0).alias("_all"), "gap")
    specs = {f"q{str(q)[2:]}": ("gap", q, "linear") for q in (0.5, 0.9, 0.99, 0.999)}
    share = lambda c: F.avg(c.cast("double"))
    x = F.col("gap")
    sums = g.groupBy("_all").agg(
        F.count("gap").alias("gaps"), F.avg("gap").alias("mean"), F.max("gap").alias("max"),
        F.count_if(x < -1e-6).alias("inversions"), F.count_if(F.abs(x) < 1e-9).alias("duplicates"),
        *[share((x >= lo) & (x < hi)).alias(f"share_{i}") for i, (lo, hi) in enumerate(zip(edges, edges[1:]))],
    )
    return sums.join(quantiles(g, ["_all"], specs, hot=hot, limit=tape.limit), "_all").drop("_all")


def coverage(tape: Tape, *, nominal: float = NOMINAL_GAP, tail: float = TAIL_SECONDS) -> DataFrame:
    """Per episode: rows, largest gap, sum of gaps, excess over the nominal cadence, first and last
    clock, span, rows in the last `tail` seconds and the largest gap starting there."""
    k, s = tape.key, F.col(tape.clock)
    g = gaps(tape)
    gap = F.coalesce(F.col("gap"), F.lit(0.0))
    return g.groupBy(k).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(gap).alias("gap_max"),
        F.sum(gap).alias("gap_sum"),
        F.sum(F.greatest(gap - nominal, F.lit(0.0))).alias("excess_sum"),
        F.max(s).alias("first_s"),
        F.min(s).alias("last_s"),
        (F.max(s) - F.min(s)).alias("span"),
        F.count_if(s <= tail).alias("tail_rows"),
        F.max(F.when(F.col("prev") <= tail, gap).otherwise(F.lit(0.0))).alias("tail_gap_max"),
    )


def coverage_drift(per_episode: DataFrame, months: DataFrame, key: str = "sample_id", wide_gap: float = 10.0) -> DataFrame:
    return per_episode.join(months, key).groupBy("month").agg(
        F.count(F.lit(1)).alias("episodes"), F.avg("rows").alias("mean_rows"), F.avg("gap_max").alias("mean_max_gap"),
        F.avg((F.col("gap_max") > wide_gap).cast("double")).alias("wide_gap_share"), F.avg("last_s").alias("mean_last_s"),
    )


def channel_health(df: DataFrame, channels: Sequence[str], *, near_zero: float = 0.01) -> DataFrame:
    """(channel, rows, finite, nonzero_share, std, state): one wide aggregation, then one row per channel."""
    inf = F.lit(float("inf"))

    def one(c: str) -> Column:
        x = F.col(c)
        fin = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)
        bad = F.count(F.lit(1)) - F.count_if(fin)
        nz = F.avg(F.when(fin, (x != 0).cast("double")))
        sd = F.stddev_pop(F.when(fin, x))
        state = F.when(bad > 0, "not finite").when(sd == 0, "constant").when(nz < near_zero, "almost all zero").otherwise("ok")
        return F.struct(
            F.lit(c).alias("channel"), F.count(F.lit(1)).alias("rows"), (bad == 0).alias("finite"),
            nz.alias("nonzero_share"), sd.alias("std"), state.alias("state"),
        )

    wide = df.agg(*[one(c).alias(c) for c in channels])
    return wide.select(F.explode(F.array(*[F.col(c) for c in channels])).alias("_c")).select("_c.*")


def known_positive_gate(scores: DataFrame, expected: DataFrame, share: float = 0.6) -> DataFrame:
    """Reference signals must reach `share` of their documented cosine; `valid` is false for every row
    when any of them fails."""
    df = expected.join(scores, "signal", "left").withColumn("passed", F.coalesce(F.abs("cos") >= share * F.col("expected"), F.lit(False)))
    verdict = df.agg(F.bool_and("passed").alias("valid"))
    return df.crossJoin(F.broadcast(verdict))


def channel_medians(df: DataFrame, channels: Sequence[str], split: str, *, hot: Hot | None, limit: int) -> DataFrame:
    """(channel, train, test, ratio): medians per split and their ratio, null where train is about 0."""
    specs = {c: (c, 0.5, "linear") for c in channels}
    med = quantiles(df.select(split, *channels), [split], specs, hot=hot, limit=limit)
    tall = med.unpivot([split], list(channels), "channel", "median")
    both = tall.groupBy("channel").agg(
        F.max(F.when(F.col(split) == "train", F.col("median"))).alias("train"),
        F.max(F.when(F.col(split) == "test", F.col("median"))).alias("test"),
    )
    return both.withColumn("ratio", F.when(F.abs("train") > 1e-9, div("test", "train")))


def quantile_table(df: DataFrame, columns: Sequence[str], split: str, *, hot: Hot | None, limit: int,
                   qs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(split, column, mean, q05 ... q95)."""
    specs = {f"{c}|{q}": (c, q, "linear") for c in columns for q in qs}
    named = {s: f"_q{i}" for i, s in enumerate(specs)}
    vals = quantiles(df.select(split, *columns), [split], {named[s]: v for s, v in specs.items()}, hot=hot, limit=limit)
    means = df.groupBy(split).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_m_{c}").alias("mean"),
                 *[F.col(named[f"{c}|{q}"]).cast("double").alias(f"q{int(round(q * 100)):02d}") for q in qs])
        for c in columns
    ]))
    return vals.join(means, split).select(split, rows.alias("_r")).select(split, "_r.*")


def null_shares(df: DataFrame, columns: Sequence[str], above: float = 0.2) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_share")) for c in columns]))
    return wide.select(pairs.alias("_p")).select("_p.*").where(F.col("null_share") > above)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, counted both ways (multiset difference)."""
    b = b.select(*a.columns)
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b")))


def relative_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(column, worst) with worst = max |a - b| / max(|a|, 1), and rows without a partner counted."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b"))
    j = left.join(right, list(keys), "full")
    rel = lambda c: F.max(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.greatest(F.abs(F.col(f"a_{c}")), F.lit(1.0)))
    lost = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    wide = j.agg(lost.alias("unmatched"), *[rel(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("worst")) for c in columns]))
    return wide.select("unmatched", rows.alias("_r")).select("_r.column", "_r.worst", "unmatched")


def edge_row_counts(tape: Tape, months: DataFrame, *, hot: Hot | None, edge: int = 30) -> DataFrame:
    """(month, side, min, median, max): row counts of the first and last `edge` episodes of a period.
    A truncated file shows as small counts on one side."""
    k = tape.key
    counts = tape.df.groupBy(k).agg(F.count(F.lit(1)).alias("rows"))
    placed = ordered(months, ["month"], [F.col(k).asc()], hot=hot, limit=tape.limit, idx="i", total="n")
    sides = F.explode(F.array_compact(F.array(
        F.when(F.col("i") < edge, F.lit("first")), F.when(F.col("i") >= F.col("n") - edge, F.lit("last"))
    )))
    picked = placed.where((F.col("i") < edge) | (F.col("i") >= F.col("n") - edge)).withColumn("side", sides)
    return picked.join(counts, k).groupBy("month", "side").agg(
        F.min("rows").alias("min"), F.percentile("rows", F.lit(0.5)).alias("median"), F.max("rows").alias("max")
    )


def index_consistency(index: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    """Episodes of the index that are not in `ids`, the other way round, and duplicates."""
    a = index.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    b = ids.select(key).distinct().withColumn("_i", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(
        F.count_if(F.col("_i").isNull()).alias("unknown"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_n") > 1).alias("duplicated"),
    )
