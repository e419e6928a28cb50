"""One wide aggregate over several kinds of rows, in parts that share their columns.

An aggregate of some hundred expressions over a union of tables updates every buffer on every row, those of the other tables too, and
Spark compiles no stage of more than 100 columns. Here the basic aggregates behind the wanted columns are collected first and dealt into
parts of at most BUFFERS buffers, each of one kind of rows. A row is handed on once per part of its kind, with the inputs of that part only;
one narrow aggregate by (key, part) serves all parts, as the n-th sum of one part and the n-th sum of another are the same column. Its few rows
per key are then put side by side. Rows keep their place, so the aggregates need no exchange that the key alone would not need.

`aggregate` does that with Spark alone. `partial` does the aggregates of a part on numpy arrays (operators/arrays.py), for rows that lie in order of
their groups; what it hands on has a row per (key, part), for `side_by_side`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Basic
from ..functions.scalars import col
from . import arrays

BUFFERS = 36
# kind -> (aggregate, types of its inputs, buffers)
KINDS = {
    "sum": (F.sum, ("double",), 1),
    "avg": (F.avg, ("double",), 2),
    "count": (F.count, ("boolean",), 1),
    "min": (F.min, ("double",), 1),
    "max": (F.max, ("double",), 1),
    "max_by": (F.max_by, ("double", "long"), 2),
    "bool_or": (F.bool_or, ("boolean",), 1),
    "stddev_samp": (F.stddev_samp, ("double",), 3),
    "skewness": (F.skewness, ("double",), 4),
}


class Terms(Basic):
    """The basic aggregates of one kind of rows. Each call returns the column that will hold the result; equal calls share one. Values are
    doubles, so whole numbers are exact up to 2^53."""

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.found: dict[tuple[str, ...], tuple[str, tuple[Column, ...]]] = {}

    def _term(self, kind: str, *inputs) -> Column:
        typed = tuple(col(x).cast(t) for x, t in zip(inputs, KINDS[kind][1]))
        name, _ = self.found.setdefault((kind, *map(str, typed)), (f"{self.prefix}{len(self.found)}", typed))
        return F.col(name)

    def sum(self, x) -> Column:
        return self._term("sum", x)

    def avg(self, x) -> Column:
        return self._term("avg", x)

    def count(self, x) -> Column:
        return self._term("count", F.when(col(x).isNotNull(), F.lit(True)))

    def count_if(self, cond) -> Column:
        return self._term("count", F.when(col(cond), F.lit(True)))

    def min(self, x) -> Column:
        return self._term("min", x)

    def max(self, x) -> Column:
        return self._term("max", x)

    def max_by(self, x, by) -> Column:
        return self._term("max_by", x, by)

    def bool_or(self, x) -> Column:
        return self._term("bool_or", x)

    def stddev_samp(self, x) -> Column:
        return self._term("stddev_samp", x)

    def skewness(self, x) -> Column:
        return self._term("skewness", x)

    def parts(self, used: set[str]) -> list[list[tuple[str, str, tuple[Column, ...]]]]:
        """(kind, name, inputs) of the used terms, dealt so that every part has about the same number of each kind."""
        terms = sorted(((kind, name, inputs) for (kind, *_), (name, inputs) in self.found.items() if name in used), key=lambda t: t[0])
        n = max(1, -(-sum(KINDS[kind][2] for kind, *_ in terms) // BUFFERS))
        return [terms[i::n] for i in range(n)]


class Parts:
    """The parts of some kinds of rows for the wanted `outputs`, which are columns in terms of the kinds' `Terms`.

    Rows carry the inputs of their parts in `columns(kind)`: structs `_part0`, `_part1`, ... of one type for all kinds. They may be made where a table's
    values are at hand; later sorts and windows copy them as a whole."""

    def __init__(self, kinds: Sequence[Terms], outputs: Mapping[str, Column]):
        self.outputs = dict(outputs)
        used = set(re.findall(r"\w+", " ".join(map(str, outputs.values()))))
        self.by_kind = [terms.parts(used) for terms in kinds]
        count = lambda part, kind: sum(k == kind for k, *_ in part)
        self.places = {kind: max(count(part, kind) for parts in self.by_kind for part in parts) for kind in KINDS}

    def _inputs(self, kind: str, i: int) -> list[str]:
        return [f"{kind}{i}_{j}" for j in range(len(KINDS[kind][1]))]

    def columns(self, kind: int) -> list[Column]:
        """Built as columns, not in the generator: Spark splits the code of a projection this wide into small methods."""
        first = sum(map(len, self.by_kind[:kind]))
        out = []
        for p, part in enumerate(self.by_kind[kind]):
            given = {}
            for kind_of, i, _, inputs in _placed(part):
                given |= dict(zip(self._inputs(kind_of, i), inputs))
            fields = [
                given.get(c, F.lit(None).cast(t)).alias(c) for k, n in self.places.items() for i in range(n) for c, t in zip(self._inputs(k, i), KINDS[k][1])
            ]
            out.append(F.struct(F.lit(first + p).alias("_part"), *fields).alias(f"_part{p}"))
        return out

    def handed(self, kind: int) -> Column:
        """The array of a row's parts."""
        return F.array(*[f"_part{p}" for p in range(len(self.by_kind[kind]))])

    def aggregate(self, df: DataFrame, key: str, handed: Column) -> DataFrame:
        """(key, outputs..., `_rows0`, `_rows1`, ...): one row per key and the number of rows of each kind, null if there are none; terms of a kind
        without rows are null."""
        narrow = df.select(key, F.inline(handed)).groupBy(key, "_part").agg(
            F.count(F.lit(1)).alias("_rows"), *[KINDS[k][0](*self._inputs(k, i)).alias(f"{k}{i}") for k, n in self.places.items() for i in range(n)]
        )
        return self._beside(narrow, key)

    def _beside(self, narrow: DataFrame, key: str) -> DataFrame:
        of_part = lambda p, c: F.max(F.when(F.col("_part") == p, F.col(c)))
        values, p = [], 0
        for i, parts in enumerate(self.by_kind):
            values.append(of_part(p, "_rows").alias(f"_rows{i}"))
            for part in parts:
                values += [of_part(p, f"{kind}{j}").alias(name) for kind, j, name, _ in _placed(part)]
                p += 1
        return narrow.groupBy(key).agg(*values).select(key, *[c.alias(n) for n, c in self.outputs.items()], *[f"_rows{i}" for i in range(len(self.by_kind))])

    # ---- on arrays

    def schema(self) -> str:
        """Of what `partial` hands on, without the key."""
        return ", ".join(f"{c} {t}" for c, t in self._values())

    def _values(self) -> list[tuple[str, str]]:
        of = {"count": "long", "bool_or": "boolean"}
        return [("_part", "int"), ("_rows", "long"), *[(f"{k}{i}", of.get(k, "double")) for k, n in self.places.items() for i in range(n)]]

    def trees(self, kind: int) -> "Trees":
        """The parts of a kind of rows as plain data, to travel to the tasks."""
        first = sum(map(len, self.by_kind[:kind]))
        parts = [[(k, f"{k}{i}", [arrays.compiled(c) for c in inputs]) for k, i, _, inputs in _placed(part)] for part in self.by_kind[kind]]
        return Trees(first, parts, self._values())

    def side_by_side(self, narrow: DataFrame, key: str) -> DataFrame:
        """What `aggregate` returns, from rows of `Trees.partial`. There is one row per key and part; the narrow aggregate deals them out."""
        values = [c for c, _ in self._values() if c != "_part"]
        return self._beside(narrow.groupBy(key, "_part").agg(*[F.max(c).alias(c) for c in values]), key)


class Trees:
    """The parts of one kind of rows: (aggregate, column, trees of its inputs) each."""

    def __init__(self, first: int, parts: list[list[tuple[str, str, list[tuple]]]], values: list[tuple[str, str]]):
        self.first, self.parts, self.values = first, parts, values
        self.uses = arrays.uses(t for part in parts for _, _, trees in part for t in trees)

    def partial(self, rows: "arrays.Rows") -> Iterator[dict[str, "arrays.Vector | None"]]:
        """Per part its columns, each with an entry per group; None for a column without values in the part."""
        rows.expecting(self.uses)
        for p, part in enumerate(self.parts, self.first):
            n = len(rows.starts)
            out = {c: None for c, _ in self.values} | {"_part": (np.full(n, p, np.int32), None), "_rows": (rows.lengths, None)}
            for kind, name, trees in part:
                out[name] = arrays.aggregate(kind, [rows.value(t) for t in trees], rows.starts, rows.size)
            yield out


def _placed(part) -> list[tuple[str, int, str, tuple[Column, ...]]]:
    """(kind, its place among its kind, name, inputs)."""
    seen = dict.fromkeys(KINDS, -1)
    out = []
    for kind, name, inputs in part:
        seen[kind] += 1
        out.append((kind, seen[kind], name, inputs))
    return out
