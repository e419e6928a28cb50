"""Row order inside a group, without ever needing a whole group in one task.

Most episodes are short, and for them a window over the episode is the right plan. A group with more
rows than `limit` is taken out, range-partitioned on its own order into blocks of about `limit`
rows, and the pieces of state that cross a block edge (row offset, running sum, last seen value, the
few rows a lag reaches back) are carried between blocks as one row per block. Both plans return
exactly the same values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

DEFAULT_LIMIT = 1_000_000
ROWS_PER_TASK = 100_000


@dataclass(frozen=True)
class Hot:
    """Groups above the row limit: one row (keys, rows) each, and what they sum to."""

    keys: DataFrame
    rows: int


def find_hot(df: DataFrame, keys: Sequence[str], limit: int = DEFAULT_LIMIT) -> Hot | None:
    """Groups with more than `limit` rows, or None. At most rows/limit of them can exist, which
    bounds every broadcast of the result."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    total = big.agg(F.sum("_rows")).first()[0]
    return None if total is None else Hot(settle(big), int(total))


@dataclass(frozen=True)
class Tape:
    """An event table: episodes `key`, countdown clock (0 = prediction time), tie-break columns that
    make the order of equal stamps total, and the hot episodes found once for the table. rows: number of events, if known; plans deal by it."""

    df: DataFrame
    key: str = "sample_id"
    clock: str = "s"
    ties: tuple[str, ...] = ()
    limit: int = DEFAULT_LIMIT
    hot: Hot | None = None
    rows: int | None = None

    @staticmethod
    def of(df: DataFrame, *, key="sample_id", clock="s", ties=(), limit=DEFAULT_LIMIT) -> "Tape":
        """Counts rows per episode once and calls the clock `s`."""
        hot = find_hot(df.select(key), [key], limit)
        return Tape(df.withColumnRenamed(clock, "s"), key, "s", tuple(ties), limit, hot)

    def newest_first(self) -> list[Column]:
        return [F.col(self.clock).asc(), *[F.col(t).asc() for t in self.ties]]

    def oldest_first(self) -> list[Column]:
        return [F.col(self.clock).desc(), *[F.col(t).asc() for t in self.ties]]

    def newest_key(self) -> list[Column]:
        return [F.col(self.clock), *[F.col(t) for t in self.ties]]

    def map(self, fn) -> "Tape":
        """Same episodes, other columns; `fn` must not add rows."""
        return replace(self, df=fn(self.df))

    def ordered(self, *, newest: bool = True, **state) -> DataFrame:
        order = self.newest_first() if newest else self.oldest_first()
        return ordered(self.df, [self.key], order, hot=self.hot, limit=self.limit, **state)


def dealt(df: DataFrame, key: str, rows: int | None) -> DataFrame:
    """Dealt by episode. With a known number of events a task gets about ROWS_PER_TASK of them at any size."""
    parts = 1 if rows is None else -(-rows // ROWS_PER_TASK)
    return df.repartition(parts, key) if parts > 1 else df.repartition(key)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    hot: Hot | None,
    limit: int = DEFAULT_LIMIT,
    idx: str | None = "idx",
    total: str | None = "n",
    lags: Mapping[str, tuple[str, int]] | None = None,
    fills: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Adds order-dependent columns per group:

    idx     0-based position; total: rows of the group
    lags    name -> (column, n): value n rows earlier in `order`
    fills   name -> column: last non-null value up to and including the row
    firsts  name -> column: first non-null value of the group
    sums    name -> column: running sum of the rows before this one (0 on the first)

    `order` must be total, else the result would depend on the partitioning.
    """
    lags, fills, firsts, sums = lags or {}, fills or {}, firsts or {}, sums or {}
    out = [*df.columns, *([idx] if idx else []), *([total] if total else []), *lags, *fills, *firsts, *sums]

    def short(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        cols = []
        if idx:
            cols.append((F.row_number().over(w) - 1).cast("long").alias(idx))
        if total:
            cols.append(F.count(F.lit(1)).over(whole).alias(total))
        cols += [F.lag(c, k).over(w).alias(o) for o, (c, k) in lags.items()]
        cols += [F.last(c, True).over(upto).alias(o) for o, c in fills.items()]
        cols += [F.first(c, True).over(whole).alias(o) for o, c in firsts.items()]
        cols += [F.coalesce(F.sum(c).over(before), F.lit(0).cast(part.schema[c].dataType)).alias(o) for o, c in sums.items()]
        return part.select("*", *cols)

    if hot is None:
        return short(df).select(*out)
    marked = F.broadcast(hot.keys.select(*keys))
    cold = short(df.join(marked, list(keys), "left_anti"))
    warm = _blocked(
        df.join(marked, list(keys), "left_semi"), keys, order, hot.rows, limit, idx or "_idx", total or "_n",
        lags, fills, firsts, sums,
    )
    return cold.select(*out).unionByName(warm.select(*out))


def _blocked(df, keys, order, rows, limit, idx, total, lags, fills, firsts, sums) -> DataFrame:
    keys = list(keys)
    parts = max(2, -(-rows // limit))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    # settled once: block numbers and rows must stay together when a task is run again
    blocks = settle(ranged.withColumn("_blk", F.spark_partition_id()))
    sizes = blocks.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_m"))
    per_group = Window.partitionBy(*keys).orderBy("_blk")
    offsets = sizes.select(
        *keys,
        "_blk",
        F.coalesce(F.sum("_m").over(per_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_m").over(Window.partitionBy(*keys)).alias(total),
    )
    local = blocks.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(*order)) - 1)
    rowsdf = (
        local.join(offsets, [*keys, "_blk"])
        .withColumn(idx, (F.col("_off") + F.col("_i")).cast("long"))
        .drop("_off", "_i", "_blk")
    )
    if firsts:
        heads = rowsdf.groupBy(*keys).agg(
            *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(o) for o, c in firsts.items()]
        )
        rowsdf = rowsdf.join(F.broadcast(heads), keys, "left")
    if not (lags or fills or sums):
        return rowsdf

    reach = max([k for _, k in lags.values()], default=0)
    size = max(limit, reach + 1)
    seg = F.floor(F.col(idx) / F.lit(size))
    rowsdf = rowsdf.withColumn("_seg", seg)
    # the last `reach` rows of a segment also travel to the next one, where lags can see them
    tail = F.col(idx) % size >= size - reach
    own = F.struct(F.col("_seg").alias("seg"), F.lit(False).alias("halo"))
    nxt = F.struct((F.col("_seg") + 1).alias("seg"), F.lit(True).alias("halo"))
    spread = rowsdf.withColumn("_to", F.explode(F.when(tail, F.array(own, nxt)).otherwise(F.array(own)))) if reach else (
        rowsdf.withColumn("_to", own)
    )
    spread = spread.withColumn("_seg", F.col("_to.seg")).withColumn("_halo", F.col("_to.halo")).drop("_to")
    w = Window.partitionBy(*keys, "_seg").orderBy(idx)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.lag(c, k).over(w).alias(o) for o, (c, k) in lags.items()]
    cols += [F.last(c, True).over(upto).alias(o) for o, c in fills.items()]
    cols += [F.sum(F.when(~F.col("_halo"), F.col(c))).over(before).alias(o) for o, c in sums.items()]
    res = spread.select("*", *cols).where(~F.col("_halo")).drop("_halo")
    if fills or sums:
        pieces = rowsdf.groupBy(*keys, "_seg").agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"_f{i}") for i, c in enumerate(fills.values())],
            *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())],
        )
        prev = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        carry = pieces.select(
            *keys,
            "_seg",
            *[F.last(f"_f{i}", True).over(prev).alias(f"_f{i}") for i in range(len(fills))],
            *[F.sum(f"_s{i}").over(prev).alias(f"_s{i}") for i in range(len(sums))],
        )
        res = res.join(carry, [*keys, "_seg"])
        for i, o in enumerate(fills):
            res = res.withColumn(o, F.coalesce(F.col(o), F.col(f"_f{i}")))
        for i, (o, c) in enumerate(sums.items()):
            zero = F.lit(0).cast(df.schema[c].dataType)
            res = res.withColumn(o, F.coalesce(F.col(o), zero) + F.coalesce(F.col(f"_s{i}"), zero))
    return res


def with_group_values(tape: Tape, values: Mapping[str, Column]) -> DataFrame:
    """Aggregates of the episode on each of its rows. Short episodes use a window, so a later window or
    groupBy on the episode needs no further shuffle; hot ones are aggregated map-side and broadcast."""
    w = Window.partitionBy(tape.key)

    def short(part: DataFrame) -> DataFrame:
        return part.select("*", *[v.over(w).alias(n) for n, v in values.items()])

    if tape.hot is None:
        return short(tape.df if tape.rows is None else dealt(tape.df, tape.key, tape.rows))
    marked = F.broadcast(tape.hot.keys.select(tape.key))
    warm = tape.df.join(marked, tape.key, "left_semi")
    per_group = F.broadcast(warm.groupBy(tape.key).agg(*[v.alias(n) for n, v in values.items()]))
    return short(tape.df.join(marked, tape.key, "left_anti")).unionByName(warm.join(per_group, tape.key))


def newest_rows(tape: Tape, k: int, *, idx: str = "idx") -> DataFrame:
    """The k newest rows of each episode with their position. Spark keeps at most k rows per episode
    and task before the shuffle (window group limit), so a hot episode costs k rows per task."""
    w = Window.partitionBy(tape.key).orderBy(*tape.newest_first())
    return (
        tape.df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= k)
        .withColumn(idx, (F.col("_rn") - 1).cast("long"))
        .drop("_rn")
    )


def oldest_row(tape: Tape) -> DataFrame:
    """One row per episode: the oldest, as `last_by` aggregates (no window)."""
    cols = [c for c in tape.df.columns if c != tape.key]
    pick = F.max_by(F.struct(*cols), F.struct(*tape.newest_key()))
    return tape.df.groupBy(tape.key).agg(pick.alias("_r")).select(tape.key, "_r.*")


def running_total(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, str], *, hot: Hot | None, limit=DEFAULT_LIMIT
) -> DataFrame:
    """Exclusive running sums along `value`, for tables with one row per (keys, value). `hot` may
    come from any table with at least as many rows per group."""
    return ordered(df, keys, [F.col(value).asc()], hot=hot, limit=limit, idx=None, total=None, sums=sums)
