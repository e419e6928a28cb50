"""Row expressions and basic aggregates on numpy arrays: what Spark columns say, for whole batches of groups at once.

A Column is read off as a tree once (`compiled`); `Rows` evaluates trees over rows that lie in order of their groups, and lags, positions and
aggregates over groups or runs within them. A vector is a pair (values, valid), valid None where no value is null; values at nulls mean nothing.
Results follow Spark: comparisons with null are null, `and` and `or` know three values, NaN is the largest number, aggregates leave nulls out.
`by_group` cuts Arrow batches that are sorted by a key into pieces of whole groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column

CHUNK = 32_768

Vector = tuple[np.ndarray, "np.ndarray | None"]
COMPARISONS = {"=": np.equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}
ARITHMETIC = {"+": np.add, "-": np.subtract, "*": np.multiply}
UNARY = {"exp": np.exp, "abs": np.abs, "negative": np.negative}
FUNCTIONS = {*COMPARISONS, *ARITHMETIC, *UNARY, "and", "or", "!", "/", "try_divide", "power", "log1p", "floor", "ceil", "coalesce", "isNotNull"}
CASTS = {"double": np.float64, "float": np.float64, "bigint": np.int64, "int": np.int64, "boolean": np.bool_}


def _literal(value) -> tuple:
    return ("lit", value, type(value).__name__)  # 1 and True are equal


NULL = _literal(None)


def compiled(column: Column) -> tuple:
    """The column's expression as nested tuples; an error for what `Rows` can't evaluate."""
    return _tree(column._jc.node())


def _all(nodes) -> list:
    it, out = nodes.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def _tree(node) -> tuple:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        return ("col", ".".join(_all(node.nameParts())))
    if kind == "Literal":
        return _literal(node.value())
    if kind == "UnresolvedExtractValue":
        return ("col", f"{_tree(node.child())[1]}.{_tree(node.extraction())[1]}")
    if kind == "Alias":
        return _tree(node.child())
    if kind == "Cast" and (to := node.dataType().simpleString()) in CASTS:
        return ("cast", to, _tree(node.child()))
    if kind == "CaseWhenOtherwise":
        pairs = [(_tree(p._1()), _tree(p._2())) for p in _all(node.branches())]
        other = node.otherwise()
        return ("when", *[x for pair in pairs for x in pair], _tree(other.get()) if other.isDefined() else NULL)
    if kind == "UnresolvedFunction" and (name := node.functionName()) in FUNCTIONS:
        args = [_tree(a) for a in _all(node.arguments())]
        if name == "/" and not (args[1][0] == "lit" and args[1][1]):
            raise NotImplementedError(f"a quotient by no number: {node.sql()}")
        return (name, *args)
    raise NotImplementedError(f"no arrays for {node.sql()}")


def _parts(tree: tuple) -> Iterator[tuple]:
    return (x for x in tree[1:] if isinstance(x, tuple))


def uses(trees: Iterable[tuple]) -> Counter:
    """How often each part of the trees is asked for when equal parts are evaluated once."""
    found: Counter = Counter()
    left = list(trees)
    while left:
        tree = left.pop()
        found[tree] += 1
        if found[tree] == 1:
            left += _parts(tree)
    return found


def both(*valid) -> np.ndarray | None:
    out = None
    for m in valid:
        out = m if out is None else out if m is None else out & m
    return out


class Rows:
    """Rows of some groups, group by group. starts: the first row of each group. derived: name -> tree, or a function of the Rows, for columns that are
    made when they are first asked for."""

    def __init__(self, columns: Mapping[str, Vector], starts: np.ndarray, size: int, derived: Mapping[str, tuple | Callable[["Rows"], Vector]]):
        self.columns, self.starts, self.size, self.derived = dict(columns), starts, size, derived
        self.lengths = np.diff(starts, append=size)
        self.group = np.repeat(np.arange(len(starts)), self.lengths)
        self.position = np.arange(size) - starts[self.group]
        self.kept: dict[tuple, Vector] = {}
        self.left: Counter = Counter()
        # NaN compares like a number only where there may be some
        self.odd = any(v.dtype == np.float64 and not np.isfinite(v if m is None else v[m]).all() for v, m in self.columns.values())

    def column(self, name: str) -> Vector:
        if name not in self.columns:
            how = self.derived[name]
            self.columns[name] = how(self) if callable(how) else self._value(how)
        return self.columns[name]

    def expecting(self, counts: Counter) -> "Rows":
        """counts: how often parts of trees will be asked for; values are kept until their last use."""
        self.left, self.kept = Counter(counts), {}
        return self

    def value(self, tree: tuple) -> Vector:
        if tree[0] in ("col", "lit"):
            return self._value(tree)
        if tree in self.kept:
            out = self.kept[tree]
        else:
            out = self._value(tree)
            if self.left[tree] > 1:
                self.kept[tree] = out
        self.left[tree] -= 1
        if self.left[tree] <= 0:
            self.kept.pop(tree, None)
        return out

    def _true(self, tree: tuple) -> np.ndarray:
        v, m = self.value(tree)
        return v if m is None else v & m

    def _value(self, tree: tuple) -> Vector:
        op, *args = tree
        if op == "col":
            return self.column(args[0])
        if op == "lit":
            return (np.float64(0), np.zeros(self.size, bool)) if args[0] is None else (np.asarray(args[0])[()], None)
        if op == "cast":
            v, m = self.value(args[1])
            return (np.trunc(v) if args[0] in ("bigint", "int") and np.asarray(v).dtype.kind == "f" else np.asarray(v)).astype(CASTS[args[0]]), m
        if op == "when":
            return self._case(args)
        if op in ("and", "or"):
            (a, ma), (b, mb) = map(self.value, args)
            v = a & b if op == "and" else a | b
            if ma is None and mb is None:
                return v, None
            ma, mb = (np.ones(self.size, bool) if m is None else m for m in (ma, mb))
            sure = (ma & ~a) | (mb & ~b) if op == "and" else (ma & a) | (mb & b)
            return (a | ~ma) & (b | ~mb) if op == "and" else (a & ma) | (b & mb), (ma & mb) | sure
        if op == "coalesce":
            v, m = self.value(args[0])
            for other in args[1:]:
                if m is None:
                    break
                w, mw = self.value(other)
                v, m = np.where(m, v, w), None if mw is None else m | mw
            return v, m
        if op == "isNotNull":
            m = self.value(args[0])[1]
            return np.ones(self.size, bool) if m is None else m, None
        values = [self.value(a) for a in args]
        v, m = [x for x, _ in values], both(*[x for _, x in values])
        with np.errstate(all="ignore"):
            if op in COMPARISONS:
                return self._compared(op, *v), m
            if op in ARITHMETIC:
                return ARITHMETIC[op](*v), m
            if op in UNARY:
                return UNARY[op](*v), m
            if op == "!":
                return ~v[0], m
            if op == "/":
                return np.divide(*v), m
            if op == "try_divide":
                zero = v[1] == 0
                return np.divide(v[0], np.where(zero, 1, v[1])), both(m, ~zero if np.ndim(zero) else np.full(self.size, not zero))
            if op == "power":
                return np.asarray(v[0], np.float64) ** (float(v[1]) if np.ndim(v[1]) == 0 else v[1]), m
            if op == "log1p":
                return np.log1p(v[0]), both(m, ~(v[0] <= -1))
            if op in ("floor", "ceil"):
                return getattr(np, op)(np.asarray(v[0], np.float64)).astype(np.int64), m
        raise NotImplementedError(op)

    def _compared(self, op: str, a, b):
        if self.odd and "f" in (np.asarray(a).dtype.kind, np.asarray(b).dtype.kind):
            x, y = np.isnan(a), np.isnan(b)
            if op in ("<", "<="):
                a, b, x, y, op = b, a, y, x, {"<": ">", "<=": ">="}[op]
            return {"=": (a == b) | (x & y), ">": (a > b) | (x & ~y), ">=": (a >= b) | x}[op]
        return COMPARISONS[op](a, b)

    def _case(self, args) -> Vector:
        *pairs, other = args
        if len(pairs) == 2 and other == NULL:
            cond = self._true(pairs[0])
            v, m = self.value(pairs[1])
            return v, cond if m is None else cond & m
        v, m = self.value(other)
        for cond, chosen in reversed(list(zip(pairs[::2], pairs[1::2]))):
            c = self._true(cond)
            w, mw = self.value(chosen)
            v = np.where(c, w, v)
            if m is not None or mw is not None:
                m = np.where(c, True if mw is None else mw, True if m is None else m)
        return v, m

    # ---- windows

    def lag(self, vector: Vector, n: int) -> Vector:
        """The value n rows before in the group, or null."""
        v, m = vector
        out = np.empty_like(v)
        out[n:] = v[: self.size - n] if n <= self.size else v[:0]
        out[:n] = v[:1]
        there = self.position >= n
        if m is not None:
            there[n:] &= m[: max(self.size - n, 0)]
        return out, there

    def runs(self, vector: Vector) -> np.ndarray:
        """First rows of the runs of equal values (nulls are equal) in a group."""
        v, m = vector
        first = self.position == 0
        differs = v[1:] != v[:-1]
        if m is not None:
            differs = (differs & m[1:] & m[:-1]) | (m[1:] != m[:-1])
        first[1:] |= differs
        return np.flatnonzero(first)

    def over(self, kind: str, vector: Vector, starts: np.ndarray) -> Vector:
        """An aggregate over runs, on each of their rows."""
        v, m = aggregate(kind, [vector], starts, self.size)
        times = np.diff(starts, append=self.size)
        return np.repeat(v, times), None if m is None else np.repeat(m, times)

    def rank(self, vector: Vector) -> np.ndarray:
        """0-based place of the value in its group, nulls last."""
        v, m = vector
        order = np.lexsort((v, self.group) if m is None else (np.where(m, v, 0), ~m, self.group))
        out = np.empty(self.size, np.int64)
        out[order] = np.arange(self.size)
        return out - self.starts[self.group]


def aggregate(kind: str, inputs: Sequence[Vector], starts: np.ndarray, size: int) -> Vector:
    """A basic aggregate by group: see KINDS in parts.py."""
    v, m = inputs[0]
    v = np.broadcast_to(v, size)
    if kind == "max_by":
        return _max_by(v, m, *inputs[1], starts, size)
    lengths = np.diff(starts, append=size)
    n = lengths if m is None else np.add.reduceat(m, starts, dtype=np.int64)
    if kind == "count":
        return n, None
    some = None if m is None else n > 0
    if kind == "bool_or":
        return np.logical_or.reduceat(v if m is None else v & m, starts), some
    with np.errstate(all="ignore"):
        if kind in ("min", "max"):
            least = v.astype(np.float64) if m is None else np.where(m, v, np.inf if kind == "min" else -np.inf)
            return (np.fmin if kind == "min" else np.maximum).reduceat(least, starts), some
        if kind in ("sum", "avg"):
            total = np.add.reduceat(v.astype(np.float64) if m is None else np.where(m, v, 0.0), starts)
            return total if kind == "sum" else total / np.maximum(n, 1), some
        # moments about the mean, of what is left of the values beside the group's first one: equal values leave exactly nothing
        first = starts if m is None else np.minimum(np.minimum.reduceat(np.where(m, np.arange(size), size), starts), size - 1)
        d = v - np.repeat(v[first], lengths)
        d = d if m is None else np.where(m, d, 0.0)
        d = d - np.repeat(np.add.reduceat(d, starts) / np.maximum(n, 1), lengths)
        d = d if m is None else np.where(m, d, 0.0)
        square = d * d
        m2 = np.add.reduceat(square, starts)
        if kind == "stddev_samp":
            return np.sqrt(m2 / np.maximum(n - 1, 1)), n > 1
        if kind == "skewness":
            return np.sqrt(n) * np.add.reduceat(square * d, starts) / np.sqrt(m2 * m2 * m2), (n > 0) & (m2 != 0)
    raise NotImplementedError(kind)


def _max_by(v, m, by, mby, starts, size) -> Vector:
    by = np.broadcast_to(by, size)
    there = np.ones(size, bool) if mby is None else np.broadcast_to(mby, size)
    most = np.maximum.reduceat(np.where(there, by, np.iinfo(np.int64).min), starts)
    hit = there & (by == np.repeat(most, np.diff(starts, append=size)))
    at = np.maximum.reduceat(np.where(hit, np.arange(size), -1), starts)
    return v[at], (at >= 0) if m is None else (at >= 0) & m[at]


def by_group(batches, key: str):
    """Tables of whole groups from batches sorted by `key`: about CHUNK rows, or one group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, rows, enough = [], 0, CHUNK
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        ends = pc.run_end_encode(table[key].combine_chunks()).run_ends
        cut = ends[-2].as_py() if len(ends) > 1 else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
            table = table.slice(cut)
        held, rows = table.to_batches(), table.num_rows
        enough = max(CHUNK, 2 * rows)  # a long group is looked at again when it has doubled
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks()


def vector(array) -> Vector:
    """A column of an Arrow table, numbers as doubles."""
    import pyarrow as pa

    chunk = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if not chunk.null_count:
        return chunk.to_numpy(zero_copy_only=False), None
    m = chunk.is_valid().to_numpy(zero_copy_only=False)
    return chunk.fill_null(0).to_numpy(zero_copy_only=False), m
