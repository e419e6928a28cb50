"""Joins on the episode clock."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..sources.shared import settle
from .ordered import Hot, Tape, dealt, find_hot, ordered


def asof_forward(left: Tape, right: Tape, columns: Sequence[str]) -> DataFrame:
    """Every left row with `columns` of the right row that has the smallest clock >= its own (the
    last state at or before it), null where there is none.

    Both tables go into one stream, oldest first, right rows before left rows of the same stamp; the
    last right row seen is the match. One shuffle, no row pairs.
    """
    k, s = left.key, left.clock
    match = F.struct(F.col(right.clock).alias("_matched_at"), *columns)
    ties = [F.col(t).alias(t) for t in left.ties]
    l = left.df.select("*", F.lit(None).cast(right.df.select(match.alias("m")).schema["m"].dataType).alias("_m"), F.lit(1).alias("_who"))
    types = dict(left.df.dtypes)
    r = right.df.select(
        *[
            F.col(right.key).alias(c) if c == k else F.col(right.clock).alias(c) if c == s else F.lit(None).cast(types[c]).alias(c)
            for c in left.df.columns
        ],
        match.alias("_m"),
        F.lit(0).alias("_who"),
        *[F.col(t).alias(f"_t{i}") for i, t in enumerate(right.ties)],
    )
    for i, t in enumerate(right.ties):
        l = l.withColumn(f"_t{i}", F.lit(None).cast(dict(right.df.dtypes)[t]))
    both = l.unionByName(r)
    # among right rows of one stamp the first in their tie order is nearest; it must come last
    order = [F.col(s).desc(), F.col("_who").asc(), *[F.col(f"_t{i}").desc() for i in range(len(right.ties))],
             *[F.col(t).asc() for t in left.ties]]
    res = ordered(
        both, [k], order, hot=either_hot(left.hot, right.hot, k), limit=left.limit, idx=None, total=None, fills={"_hit": "_m"}
    )
    return res.where(F.col("_who") == 1).select(*left.df.columns, "_hit._matched_at", *[f"_hit.{c}" for c in columns])


def either_hot(a: Hot | None, b: Hot | None, key: str) -> Hot | None:
    """Groups that are hot in either table."""
    if a is None or b is None:
        return a or b
    both = a.keys.unionByName(b.keys).groupBy(key).agg(F.sum("_rows").alias("_rows"))
    return Hot(settle(both), a.rows + b.rows)


def nearest(tape: Tape, horizons: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """(key, h, columns of the row with the smallest |s - h|); the newer row wins a tie. One mergeable
    minimum per horizon, so no row is multiplied and hot episodes combine map-side."""
    s = F.col(tape.clock)
    picks = [
        F.min_by(F.struct(s.alias("at"), *columns), F.struct(F.abs(s - F.lit(float(h))), *tape.newest_key())).alias(f"_h{i}")
        for i, h in enumerate(horizons)
    ]
    wide = tape.df.groupBy(tape.key).agg(*picks)
    long = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(f"_h{i}").alias("r")) for i, h in enumerate(horizons)]))
    return wide.select(tape.key, long.alias("_x")).select(tape.key, "_x.h", "_x.r.at", *[f"_x.r.{c}" for c in columns])


def nearest_present(tape: Tape, horizons: Sequence[float], column: str, reach: int = 4) -> DataFrame:
    """(key, h, now, then): `then` is the non-null value closest in rows to the row nearest h, at most
    `reach` rows away, the older row first at equal distance; `now` the newest non-null value.
    Rows without any are left out.

    Each row looks at its own neighbours first (lags both ways), so the horizon pick stays one
    mergeable minimum per episode."""
    k, s = tape.key, F.col(tape.clock)
    older = {f"_o{i}": (column, i) for i in range(1, reach + 1)}
    newer = {f"_n{i}": (column, i) for i in range(1, reach + 1)}
    fwd = ordered(tape.df.select(k, tape.clock, *tape.ties, column), [k], tape.newest_first(), hot=tape.hot, limit=tape.limit, total=None, lags=newer)
    backwards = [F.col("idx").desc()]
    df = ordered(fwd, [k], backwards, hot=tape.hot, limit=tape.limit, idx=None, total=None, lags=older)
    probe = F.coalesce(F.col(column), *[F.col(f"_{d}{i}") for i in range(1, reach + 1) for d in ("o", "n")])
    df = df.withColumn("then", probe)
    found = replace(tape, df=df)
    now = df.groupBy(k).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("idx"))).alias("now"))
    hits = nearest(replace(found, ties=("idx",)), horizons, ["then"])
    return hits.join(now, k).where(F.col("now").isNotNull() & F.col("then").isNotNull()).select(k, "h", "now", "then")


def shift_match(
    a: DataFrame, b: DataFrame, pair_key: str, clock: str, attrs: Sequence[str], shifts: Sequence[float], step: float
) -> DataFrame:
    """Share of distinct events of `a` at least d seconds old whose copy, d seconds newer and equal in
    `attrs`, occurs in `b`, per pair and shift d. Clocks are compared on a grid of `step` seconds.

    Each side is one row per pair and attributes with the set of its ticks, and a shift is an intersection of two such sets, so no
    row is copied per shift. A set has an entry per tick of the clock's span at most. How many events are old enough for a shift comes
    from counts per pair and shift class."""
    tick = F.round(F.col(clock) / F.lit(step)).cast("long")
    left = a.select(pair_key, tick.alias("_t"), *attrs)
    right = b.select(pair_key, tick.alias("_t"), *attrs)
    ds = sorted(float(d) for d in shifts)
    ticks = F.array(*[F.lit(int(round(d / step))).cast("long") for d in ds])

    # class = number of shifts an event is old enough for; the running total from the top counts events
    klass = F.size(F.filter(ticks, lambda x: x <= F.col("_t")))
    classes = left.distinct().groupBy(pair_key, klass.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    every = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("_c"), F.lit(d).alias("d")) for i, d in enumerate(ds)])).alias("_e")
    slots = left.select(pair_key).distinct().select(pair_key, every).select(pair_key, "_e._c", "_e.d", F.lit(0).cast("long").alias("_n"))
    both = classes.withColumn("d", F.lit(None).cast("double")).unionByName(slots)
    from_top = Window.partitionBy(pair_key).orderBy(F.col("_c").desc()).rangeBetween(Window.unboundedPreceding, 0)
    old_enough = both.withColumn("events", F.sum("_n").over(from_top)).where(F.col("d").isNotNull() & (F.col("events") > 0))

    mine = left.groupBy(pair_key, *attrs).agg(F.collect_set("_t").alias("_a"))
    theirs = right.groupBy(pair_key, *attrs).agg(F.collect_set("_t").alias("_b"))
    equal = lambda dt: F.size(F.array_intersect("_a", F.transform("_b", lambda t: t + dt)))
    sets = mine.join(theirs, [pair_key, *attrs]).select(pair_key, F.transform(ticks, equal).alias("_m"))
    sums = sets.groupBy(pair_key).agg(F.array(*[
        F.struct(F.lit(d).alias("d"), F.sum(F.col("_m")[i]).alias("matched")) for i, d in enumerate(ds)
    ]).alias("_m"))
    hits = sums.select(pair_key, F.inline("_m"))
    return old_enough.select(pair_key, "d", "events").join(hits, [pair_key, "d"], "left").select(
        pair_key, "d", "events", F.coalesce("matched", F.lit(0)).alias("matched"),
        div(F.coalesce("matched", F.lit(0)), "events").alias("rate"),
    )


def best_shift(matches: DataFrame, pair_key: str) -> DataFrame:
    """Shift with the highest rate per pair, the smallest shift on ties."""
    pick = F.max_by(F.struct("d", "rate"), F.struct("rate", -F.col("d")))
    return matches.groupBy(pair_key).agg(pick.alias("_b")).select(pair_key, "_b.d", "_b.rate")


def key_overlap(a: DataFrame, b: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Per episode, how many distinct attribute tuples of `a` occur in `b`."""
    right = b.select(key, *attrs).distinct().withColumn("_hit", F.lit(1))
    return (
        a.select(key, *attrs)
        .distinct()
        .join(right, [key, *attrs], "left")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("keys"), F.count("_hit").alias("shared"))
    )


def lookup(events: DataFrame, table: DataFrame, key: str, fallback: dict[str, float], floors: dict[str, float] | None = None) -> DataFrame:
    """Scale constants of `table` on every event; null or missing constants take the fallback, then
    the floor is applied."""
    cols = [c for c in table.columns if c != key]
    df = events.join(table, key, "left")
    for c in cols:
        v = F.col(c)
        if c in fallback:
            v = F.coalesce(v, F.lit(float(fallback[c])))
        if floors and c in floors:
            v = F.greatest(v, F.lit(float(floors[c])))
        df = df.withColumn(c, v)
    return df


def complete_grid(ids: DataFrame, cells: DataFrame, key: str, bin_col: str, bins: int) -> DataFrame:
    """Every (episode, bin 0..bins-1), value columns 0 where the cell is missing."""
    grid = ids.select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias(bin_col))
    values = [c for c in cells.columns if c not in (key, bin_col)]
    return grid.join(cells, [key, bin_col], "left").na.fill(0, values)


def state_match(a: Tape, b: Tape, columns: Sequence[str], shifts: Sequence[float]) -> DataFrame:
    """For every shift d: rows of `a` whose clock + d lies inside b's range, and how many of them equal
    the b row nearest to it in all `columns` (the newer row wins a tie). Episodes of `a` and `b` are
    paired by key.

    The nearest row is either the last one at or above the target or the first one below it: two
    as-of lookups per (row, shift), no row pairs."""
    k, s = a.key, a.clock
    shift_list = F.explode(F.array(*[F.lit(float(d)) for d in shifts]))
    # every row is looked up once per shift, so a group counts as hot that much earlier
    hot = find_hot(a.df.select(k), [k], max(1, a.limit // len(shifts)))
    hot = None if hot is None else replace(hot, rows=hot.rows * len(shifts))
    if a.rows is not None and hot is None and b.hot is None:
        # rows are dealt before they are copied per shift, and both lookups run where they were dealt
        rows = a.rows * len(shifts)
        a, b = (t.map(lambda df, columns=[k, t.clock, *t.ties, *columns]: dealt(df.select(*dict.fromkeys(columns)), k, rows)) for t in (a, b))
    span = b.df.groupBy(k).agg(F.min(b.clock).alias("_lo"), F.max(b.clock).alias("_hi"))
    target = a.df.select(
        k, s, *a.ties, F.struct(*columns).alias("_state"), shift_list.alias("d")
    ).withColumn("_own", F.col(s)).withColumn(s, F.col(s) + F.col("d"))
    target = target.join(span, k).where(F.col(s).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    probes = Tape(target, k, s, ("d", "_own", *a.ties), a.limit, hot)
    states = b.map(lambda df: df.select(k, b.clock, *b.ties, F.struct(*columns).alias("_other")))
    above = asof_forward(probes, states, ["_other"])
    above = above.withColumnRenamed("_matched_at", "_above_at").withColumnRenamed("_other", "_above")
    flip = lambda df: df.withColumn(s, -F.col(s))
    below = asof_forward(replace(probes, df=flip(above)), states.map(flip), ["_other"])
    up_gap, down_gap = F.col("_above_at") + F.col(s), -F.col(s) + F.col("_matched_at")
    same = F.when(
        F.col("_matched_at").isNotNull() & (F.col("_above_at").isNull() | (down_gap <= up_gap)),
        F.col("_other") == F.col("_state"),
    ).otherwise(F.col("_above") == F.col("_state"))
    return below.groupBy(k, "d").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(same).alias("matched"),
        div(F.count_if(same), F.count(F.lit(1))).alias("rate"),
    )
