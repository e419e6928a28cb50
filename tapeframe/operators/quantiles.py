"""Exact quantiles per group. Short groups use one aggregate; a hot group is reduced to its value
counts, whose running total says which value holds a given rank."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div
from ..sources.shared import settle
from .ordered import DEFAULT_LIMIT, Hot, running_total

Spec = tuple[str, float, str]  # column, q, "linear" or "nearest"


def quantiles(
    df: DataFrame, keys: Sequence[str], specs: Mapping[str, Spec], *, hot: Hot | None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """One row per group, one column per spec. Nulls are left out; a group without values gets null.

    linear   position (n-1)q, interpolated between its two neighbours
    nearest  the value at rank (n-1)q rounded half up
    """
    keys = list(keys)

    # one buffer per column, whatever the number of its quantiles
    shares: dict[str, list[float]] = {}
    for column, q, method in specs.values():
        if method == "linear" and q not in shares.setdefault(column, []):
            shares[column].append(q)
    linear = {c: f"_linear{i}" for i, c in enumerate(c for c, qs in shares.items() if qs)}

    def short(part: DataFrame) -> DataFrame:
        buffers = [F.percentile(c, F.array(*map(F.lit, shares[c]))).alias(name) for c, name in linear.items()]
        nearest = [nearest_rank(c, q).alias(o) for o, (c, q, method) in specs.items() if method == "nearest"]
        pick = [F.col(linear[c])[shares[c].index(q)].alias(o) if method == "linear" else F.col(o) for o, (c, q, method) in specs.items()]
        return part.groupBy(*keys).agg(*buffers, *nearest).select(*keys, *pick)

    if hot is None:
        return short(df)
    marked = F.broadcast(hot.keys.select(*keys))
    warm = _by_counts(df.join(marked, keys, "left_semi"), keys, specs, hot, limit)
    return short(df.join(marked, keys, "left_anti")).unionByName(warm)


def cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str], *, nulls: bool = False) -> DataFrame:
    """One row per row and column (`_c` its number, `_v` its value as double), nulls left out unless asked for."""
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)]))
    long = df.select(*keep, cell.alias("_x")).select(*keep, "_x._c", "_x._v")
    return long if nulls else long.where(F.col("_v").isNotNull())


def _counted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _c, _v, _m rows of the value), settled, as it is read several times and its rows may come from joins."""
    return settle(cells.groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("_m")))


def _value_counts(counts: DataFrame, keys: list[str], columns: int, hot: Hot, limit: int) -> DataFrame:
    """(keys, _c, _v, _m rows of the value, _before, _n rows of the group) for all columns in one running total over `_counted` values
    of hot groups."""
    each = [*keys, "_c"]
    numbers = counts.sparkSession.range(columns).select(F.col("id").cast("int").alias("_c"))
    wide = Hot(hot.keys.select(*keys).crossJoin(numbers), hot.rows * columns)
    total = running_total(counts, each, "_v", {"_before": "_m"}, hot=wide, limit=limit)
    # a row per hot group and column
    return total.join(F.broadcast(counts.groupBy(*each).agg(F.sum("_m").alias("_n"))), each)


def nearest_rank(column: str, q: float) -> Column:
    """The value at rank (n-1)q rounded half up, as an aggregate that holds the group's values."""
    rank = F.floor((F.count(column) - 1) * F.lit(q) + F.lit(0.5)).cast("int")
    return F.when(F.count(column) > 0, F.get(F.sort_array(F.collect_list(column)), rank))


def _by_counts(df: DataFrame, keys: list[str], specs: Mapping[str, Spec], hot: Hot, limit: int) -> DataFrame:
    """All quantiles of all columns from one running total over their value counts; a row for every group of `df`, which need not be all hot ones."""
    columns = list(dict.fromkeys(c for c, _, _ in specs.values()))
    counts = _counted(cells(df, columns, keys, nulls=True), keys)
    ranked = _value_counts(counts.where(F.col("_v").isNotNull()), keys, len(columns), hot, limit)
    found, out = [], []
    for i, (name, (column, q, method)) in enumerate(specs.items()):
        mine = F.col("_c") == columns.index(column)
        pos = (F.col("_n") - 1) * F.lit(q)
        if method == "nearest":
            pos = F.floor(pos + 0.5).cast("double")

        def at(rank: Column, mine=mine) -> Column:
            return F.max(F.when(mine & (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_m")), F.col("_v")))

        found += [at(F.floor(pos)).alias(f"_l{i}"), at(F.ceil(pos)).alias(f"_h{i}"), F.max(F.when(mine, pos - F.floor(pos))).alias(f"_w{i}")]
        lo, hi, w = F.col(f"_l{i}"), F.col(f"_h{i}"), F.col(f"_w{i}")
        out.append((lo.cast(df.schema[column].dataType) if method == "nearest" else lo + (hi - lo) * w).alias(name))
    return counts.select(*keys).distinct().join(ranked.groupBy(*keys).agg(*found), keys, "left").select(*keys, *out)


def with_ranks(
    df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, bool]], *, hot: Hot | None, limit: int = DEFAULT_LIMIT,
    min_rows: int = 2,
) -> DataFrame:
    """Adds one column per spec: name -> (numeric column, normalised), the average 1-based rank within `keys`.
    normalised maps it to [-1, 1] and gives null in groups below `min_rows`. Null values keep a null rank.

    Hot groups take all columns at once: rows are settled with a number, their cells counted by value, ranked by one
    running total, joined back by value and gathered by row; the plan has as many joins for one column as for many.
    """
    keys = list(keys)

    def scaled(rank: Column, n: Column, normalised: bool) -> Column:
        return F.when(n >= min_rows, div(2 * (rank - 1), n - 1) - 1) if normalised else rank

    def short(part: DataFrame) -> DataFrame:
        w, out = Window.partitionBy(*keys), {}
        for name, (value, normalised) in specs.items():
            x = F.col(value)
            ties = F.count(x).over(Window.partitionBy(*keys, value))
            rank = F.rank().over(w.orderBy(x.asc_nulls_last())) + (ties - 1) / F.lit(2.0)
            out[name] = F.when(x.isNotNull(), scaled(rank, F.count(x).over(w), normalised))
        return part.withColumns(out)

    if hot is None:
        return short(df)
    marked = F.broadcast(hot.keys.select(*keys))
    columns = list(dict.fromkeys(value for value, _ in specs.values()))
    warm = settle(df.join(marked, keys, "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    each, on = cells(warm, columns, ["_row", *keys]), [*keys, "_c", "_v"]
    rank = (F.col("_before") + (F.col("_m") + 1) / F.lit(2.0)).alias("_r")
    table = settle(_value_counts(_counted(each, keys), keys, len(columns), hot, limit).select(*on, "_m", "_n", rank))
    # values that more than `limit` rows share are few: at most cells / limit
    often, rare = table.where(F.col("_m") > limit).drop("_m"), table.where(F.col("_m") <= limit).drop("_m")
    rest = each.join(F.broadcast(often.select(*on)), on, "left_anti")
    found = each.join(F.broadcast(often), on).unionByName(rest.join(rare, on))
    gathered = found.groupBy("_row").agg(*[
        F.max(F.when(F.col("_c") == columns.index(value), scaled(F.col("_r"), F.col("_n"), normalised))).alias(name)
        for name, (value, normalised) in specs.items()
    ])
    ranked = warm.drop(*specs).join(gathered, "_row", "left").drop("_row")
    return short(df.join(marked, keys, "left_anti")).unionByName(ranked)


def with_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str, *, hot: Hot | None, limit: int = DEFAULT_LIMIT,
    normalised: bool = False, min_rows: int = 2,
) -> DataFrame:
    """`with_ranks` for one column."""
    return with_ranks(df, keys, {out: (value, normalised)}, hot=hot, limit=limit, min_rows=min_rows)


def cut_points(df: DataFrame, value: str, bins: int, *, keys: Sequence[str] = (), hot=None, limit=DEFAULT_LIMIT) -> DataFrame:
    """Inner equal-frequency cut points (linear quantiles i/bins) as one array column `cuts` per group."""
    specs = {f"_q{i}": (value, i / bins, "linear") for i in range(1, bins)}
    points = quantiles(df, keys, specs, hot=hot, limit=limit)
    return points.select(*keys, F.array(*specs).alias("cuts"))


def bin_of(value: str | Column, cuts: str = "cuts") -> Column:
    """Number of cut points strictly below the value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.size(F.filter(F.col(cuts), lambda c: c < v)).cast("int")


def auc(df: DataFrame, score: str, label: str, *, hot: Hot | None, keys: Sequence[str], limit=DEFAULT_LIMIT) -> DataFrame:
    """AUC of `score` for boolean `label` per group, ties counting half; null with one class only."""
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(
        F.count_if(F.col(label)).alias("_p"), F.count_if(~F.col(label)).alias("_q")
    )
    ranked = running_total(counts, keys, score, {"_below": "_q"}, hot=hot, limit=limit)
    wins = F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / F.lit(2.0)))
    return ranked.groupBy(*keys).agg(div(wins, F.sum("_p").cast("double") * F.sum("_q")).alias("auc"))
