"""All factors of an episode from one pass over each source table.

Trades, snapshots and orders become one table that is dealt by episode and sorted by episode, table and clock. A task reads it in batches of whole
episodes as arrays: windows, the as-of lookup, the row expressions of the factors' definitions and their basic aggregates run on numpy
(operators/arrays.py), over all episodes of a batch at once. The basic aggregates come back in parts (operators/parts.py); what the factors make of them is
a projection over one row per episode.

For episodes below the row limit; `cross.catalogue` sends hot ones through the plans that split an episode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import SPARK, Basic
from ..functions.scalars import div
from ..operators import arrays
from ..operators.arrays import Rows, Vector
from ..operators.ordered import Tape, dealt
from ..operators.parts import Parts, Terms, Trees
from . import book, depth, order, trade

MARKET, TRADE, ORDER, SIZES = 0, 1, 2, 3
EVENTS = ("price", "volume", "side", "order_action", "q90", "q95")
BOOKS = (*depth.QUOTES, "ask_price_2", "bid_price_2", "ask_volume_2", "bid_volume_2", "transaction_avgprice", "transaction_volume")


def second_factors(prefix: str, A: Basic = SPARK) -> dict[str, Callable[[], Column]]:
    """Aggregates of events that compare seconds; autocorrelations are of the seconds' mean prices."""
    sec, dev = F.col("sec"), F.col("_dev")
    autocorr = lambda n: div(A.fsum(dev * F.col(f"_dev{n}")), A.sum(dev * dev))
    return {
        f"{prefix}_has_data_15": lambda: A.count_if(F.col("_newest") & (sec <= 15)),
        f"{prefix}_miss_max": lambda: F.greatest(A.min(sec), 60 - A.max(sec), A.max("_silent")).cast("long"),
        f"{prefix}_vol_max30": lambda: A.max("_v30"),
        "t_autocorr_lag1": lambda: autocorr(1),
        "t_autocorr_lag5": lambda: autocorr(5),
        "burst5": lambda: div(A.max("_cnt5"), A.count("s")),  # largest share of trades in one 5 s bucket
    }


def ranked_quantile(column: str, q: float, method: str, A: Basic = SPARK) -> Column:
    """A quantile as an aggregate over rows that know their value's 0-based rank and the number of values."""
    rank, place = F.col(f"_r_{column}"), (F.col(f"_n_{column}") - 1) * F.lit(q)
    at = lambda r: A.max(F.when(rank == r, F.col(column)))
    if method == "nearest":
        return at(F.floor(place + F.lit(0.5)))
    low, high, share = at(F.floor(place)), at(F.ceil(place)), A.max(place - F.floor(place))
    return F.when(low == high, low).otherwise(low * (1 - share) + high * share)


# ---- columns that rows get beside those of their table, on arrays ---------------------------------


def _lag(name: str, n: int) -> Callable[[Rows], Vector]:
    return lambda r: r.lag(r.column(name), n)


def _whole(vector: Vector) -> Vector:
    return np.floor(vector[0]), vector[1]


def _five(r: Rows) -> Vector:
    v, m = r.column("sec")
    return np.floor(v / 5), m


def _over_second(kind: str, value: Callable[[Rows], Vector]) -> Callable[[Rows], Vector]:
    return lambda r: r.over(kind, value(r), r.runs(r.column("sec")))


def _volume30(r: Rows) -> Vector:
    (s, ms), (v, m) = r.column("s"), r.column("volume")
    return v, arrays.both(s <= 30, ms, m)


def _newest(r: Rows) -> Vector:
    """The newest row of a second."""
    (sec, m), (before, mb) = r.column("sec"), _whole(r.column("_s1"))
    return arrays.both(~mb | (before != sec), m), None


def _silent(r: Rows) -> Vector:
    (sec, _), (before, mb) = r.column("sec"), _whole(r.column("_s1"))
    return sec - before - 1, mb & r.column("_newest")[0]


def _deviations(r: Rows) -> list[Vector]:
    """The second's mean price less the mean over seconds, and the same some seconds with events before, on a second's newest row."""
    at = np.flatnonzero(r.column("_newest")[0])
    if not len(at):
        return [(np.zeros(r.size), np.zeros(r.size, bool))] * 3
    v, m = r.column("_px")
    first = np.flatnonzero(np.diff(r.group[at], prepend=-1))
    seconds = Rows({"px": (v[at], None if m is None else m[at])}, first, len(at), {})
    px = seconds.column("px")
    mean, some = seconds.over("avg", px, first)
    out = []
    for x, mx in (px, seconds.lag(px, 1), seconds.lag(px, 5)):
        value, valid = np.zeros(r.size), np.zeros(r.size, bool)
        value[at] = x - mean
        there = arrays.both(mx, some)
        valid[at] = True if there is None else there
        out.append((value, valid))
    return out


def _of_events() -> dict[str, tuple | Callable[[Rows], Vector]]:
    """Events with lags, position, size, differences and the second's values."""
    out = {o: _lag(c, n) for o, (c, n) in trade.lags("s").items()}
    out |= {
        "idx": lambda r: (r.position, None),
        "n": lambda r: (r.lengths[r.group], None),
        "sec": lambda r: _whole(r.column("s")),
        "_v30": _over_second("sum", _volume30),
        "_cnt5": lambda r: r.over("count", r.column("s"), r.runs(_five(r))),
        "_px": _over_second("avg", lambda r: r.column("price")),
        "_newest": _newest,
        "_silent": _silent,
        "_deviations": _deviations,
        **{name: lambda r, i=i: r.column("_deviations")[i] for i, name in enumerate(("_dev", "_dev1", "_dev5"))},
    }
    *changes, _, sign = trade.changes()
    return out | {c._jc.node().name().head(): arrays.compiled(c) for c in (*changes, sign)}


def _of_books() -> dict[str, tuple | Callable[[Rows], Vector]]:
    """Snapshots with book quantities, lags and the ranks of the values that quantiles are taken of. Clock `_ms`, position `_mi`."""
    out = {c._jc.node().name().head(): arrays.compiled(c) for c in book.quantities()}
    out |= {o: _lag(c, n) for o, (c, n) in book.LAGS.items()} | {o: arrays.compiled(c) for o, c in book.changes().items()}
    out |= {"_ms": lambda r: r.column("s"), "_mi": lambda r: (r.position, None)}
    for c in {column for column, *_ in book.QUANTILES.values()}:
        out |= {f"_r_{c}": lambda r, c=c: (r.rank(r.column(c)), None), f"_n_{c}": lambda r, c=c: r.over("count", r.column(c), r.starts)}
    return out


# ---- a batch --------------------------------------------------------------------------------------


def _states(trades: Rows, of_trades: np.ndarray, books: Rows, of_books: np.ndarray, groups: int) -> Vector:
    """The snapshot at or before each trade, as its row. Of snapshots with one stamp it is the first in their order; a trade without a clock comes last."""
    clock = lambda v, m: v if m is None else np.where(m, v, -np.inf)
    at = np.concatenate([clock(*trades.column("s")), clock(*books.column("s"))])
    is_book = np.repeat([0, 1], [trades.size, books.size])
    order = np.lexsort((is_book, at, np.concatenate([of_trades[trades.group], of_books[books.group]])))
    before = np.empty(len(at), np.int64)
    before[order] = np.cumsum(is_book[order])
    ends = np.cumsum(np.bincount(of_books[books.group], minlength=groups))
    row = before[: trades.size]
    there = row < ends[of_trades[trades.group]]
    return np.where(there, row, 0), there


def _batch(table, key: str, derived: Mapping, trees: Mapping[str, tuple[int, Trees]]) -> Iterator:
    """The parts of all episodes in a table of whole episodes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    runs = pc.run_end_encode(table[key].combine_chunks()).run_ends.to_numpy()
    episode = np.repeat(np.arange(len(runs)), np.diff(runs, prepend=0))
    who = table["_who"].to_numpy()
    columns = {c: arrays.vector(table[c]) for c in table.column_names if c.startswith("_x") or c == "_at"}
    rows, of = {}, {}
    for kind, names in ((MARKET, BOOKS), (TRADE, EVENTS), (ORDER, EVENTS)):
        at = np.flatnonzero(who == kind)
        if len(at):
            starts = np.flatnonzero(np.diff(episode[at], prepend=-1))
            mine = {n: tuple(None if x is None else x[at] for x in columns[c]) for n, c in zip(("s", *names), ("_at", *[f"_x{i}" for i in range(len(names))])) if c in columns}
            rows[kind], of[kind] = Rows(mine, starts, len(at), derived[kind]), episode[at][starts]
    sizes = np.flatnonzero(who == SIZES)
    if len(sizes) and TRADE in rows:
        for n in ("q90", "q95"):
            v, m = (None if x is None else x[sizes] for x in columns[f"_x{EVENTS.index(n)}"])
            most, there = np.full(len(runs), -np.inf), np.zeros(len(runs), bool)
            m = np.ones(len(sizes), bool) if m is None else m
            np.maximum.at(most, episode[sizes][m], v[m])
            there[episode[sizes][m]] = True
            rows[TRADE].columns[n] = tuple(x[of[TRADE]][rows[TRADE].group] for x in (most, there))
    if "depth" in trees and TRADE in rows:
        of_state = dict.fromkeys(depth.QUOTES, (np.zeros(rows[TRADE].size), np.zeros(rows[TRADE].size, bool)))
        if MARKET in rows:
            at, there = _states(rows[TRADE], of[TRADE], rows[MARKET], of[MARKET], len(runs))
            of_state = {c: (v[at], there if m is None else there & m[at]) for c, (v, m) in ((c, rows[MARKET].column(c)) for c in depth.QUOTES)}
        rows[TRADE].columns |= {f"_state.{c}": x for c, x in of_state.items()}
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    for kind, tree in trees.values():
        if kind not in rows:
            continue
        keys = table[key].combine_chunks().take(pa.array(runs[of[kind]] - 1))
        for part in tree.partial(rows[kind]):
            out = [keys]
            for c, t in tree.values:
                v, m = part[c] or (np.zeros(len(keys)), np.zeros(len(keys), bool))
                out.append(pa.array(v.astype(types[t].to_pandas_dtype(), copy=False), mask=None if m is None else ~m))
            yield pa.RecordBatch.from_arrays(out, [key, *[c for c, _ in tree.values]])


def _run(batches, key: str, derived: Mapping, trees: Mapping[str, tuple[int, Trees]]) -> Iterator:
    import pyarrow as pa

    for table in arrays.by_group(batches, key):
        found = list(_batch(table, key, derived, trees))
        yield from pa.Table.from_batches(found).combine_chunks().to_batches() if found else []


# ---- the plan -------------------------------------------------------------------------------------


def _source(tape: Tape, who: int, columns: Sequence[str], key: str) -> DataFrame:
    """A table's rows in the columns that all tables share. Ties keep their type, and share a column with those of another table if that is the same."""
    df = tape.df
    ties = [F.col(c).alias(f"_tie{i}_{re.sub(r'[^a-z0-9]', '_', df.schema[c].dataType.simpleString())}") for i, c in enumerate(tape.ties)]
    values = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns) if c in df.columns]
    return df.select(F.col(tape.key).alias(key), F.lit(who).alias("_who"), F.col(tape.clock).cast("double").alias("_at"), *ties, *values)


def episode_factors(
    market: Tape, trades: Tape, orders: Tape, sizes: DataFrame | None, book_names: Sequence[str], trade_names: Sequence[str], order_names: Sequence[str], depth_names: Sequence[str]
) -> DataFrame:
    """The named factors, one row per episode with snapshots; those of trades and orders are null without any. Large-trade thresholds (key, q90, q95)
    come in as rows of their own."""
    k = market.key
    if sizes is not None and "q90" in trades.df.columns:
        raise ValueError("thresholds are given twice")
    b, t, d, o = (Terms(f"_of_{x}") for x in ("book", "trades", "depth", "orders"))
    by_book, by_trade, by_depth, by_order = book.aggregates("_ms", "_mi", b), trade.aggregates(t), depth.aggregates("s", A=d), order.aggregates(o)
    by_second, orders_by_second = second_factors("t", t), second_factors("o", o)
    outputs = {
        "book": {n: ranked_quantile(*book.QUANTILES[n], b) if n in book.QUANTILES else by_book[n]() for n in book_names},
        "trade": {n: (by_trade[n] if n in by_trade else by_second[n])() for n in trade_names},
        "depth": {n: by_depth[n] for n in depth_names},
        "order": {n: (by_order[n] if n in by_order else orders_by_second[n])() for n in order_names},
    }
    kinds = {name: kind for name, kind in (("book", (MARKET, b)), ("trade", (TRADE, t)), ("depth", (TRADE, d)), ("order", (ORDER, o))) if outputs[name]}
    parts = Parts([terms for _, terms in kinds.values()], {n: c for some in outputs.values() for n, c in some.items()})

    tables = [_source(market, MARKET, BOOKS, k)]
    if "trade" in kinds or "depth" in kinds:
        tables.append(_source(trades, TRADE, EVENTS, k))
        if sizes is not None:
            tables.append(_source(Tape(sizes.withColumn("s", F.lit(None).cast("double")), trades.key), SIZES, EVENTS, k))
    if "order" in kinds:
        tables.append(_source(orders, ORDER, EVENTS, k).where(F.col(k).isNotNull()))  # orders of no episode belong to none
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
    ties = sorted((c for c in rows.columns if c.startswith("_tie")), key=lambda c: int(re.findall(r"\d+", c)[0]))
    rows = dealt(rows, k, trades.rows).sortWithinPartitions(k, "_who", "_at", *ties).drop(*ties)
    events = _of_events()
    run = partial(_run, key=k, derived={MARKET: _of_books(), TRADE: events, ORDER: events}, trees={n: (kind, parts.trees(i)) for i, (n, (kind, _)) in enumerate(kinds.items())})
    narrow = rows.mapInArrow(run, f"`{k}` {rows.schema[k].dataType.simpleString()}, {parts.schema()}")
    wide = parts.side_by_side(narrow, k).where(F.col("_rows0") > 0)
    there = {n: F.col(f"_rows{i}") > 0 for i, n in enumerate(kinds)}
    return wide.select(k, *[(F.col(n) if name == "book" else F.when(there[name], F.col(n))).alias(n) for name, some in outputs.items() for n in some])
