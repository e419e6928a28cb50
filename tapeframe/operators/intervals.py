"""Which values of many columns may hold a wanted rank, found without moving the others.

A sample of the rows cuts every column into intervals. One reading counts the values of each interval and fold, which says for every rank in which interval
it lies, whatever the sample was; a second one hands on the values of these intervals only, counted. The sample decides how many values are handed on,
never a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import vector

INTERVALS, SAMPLE = 1024, 8192


def cut(df: DataFrame, columns: Sequence[str], rows: int) -> list[np.ndarray]:
    """Per column at most INTERVALS cuts, from some SAMPLE of the `rows` rows; that many numbers a column come to the driver."""
    some = df.select(*[F.col(c).cast("double") for c in columns]).sample(min(1.0, SAMPLE / max(rows, 1)), seed=1).toArrow()
    out = []
    for column in some.columns:
        v, m = vector(column)
        v = np.sort(v if m is None else v[m])
        v = v[~np.isnan(v)]
        out.append(np.unique(v[np.linspace(0, len(v) - 1, min(INTERVALS, len(v))).astype(np.int64)]))
    return out


def _placed(batch, cuts: Sequence[np.ndarray], folds: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(column, values, their folds, their intervals); folds of another number than 0 .. folds-1 are number `folds`."""
    f, m = vector(batch.column(0))
    known = np.ones(len(f), bool) if m is None else m
    f = np.where((f >= 0) & (f < folds), f, folds).astype(np.int64)
    for c, at in enumerate(cuts):
        v, m = vector(batch.column(c + 1))
        there = known if m is None else known & m
        if not there.all():
            v, own = v[there], f[there]
        else:
            own = f
        yield c, v, own, np.searchsorted(at, v, side="right")


def _typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.col("fold").cast("long").alias("fold"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)])


def counted(df: DataFrame, columns: Sequence[str], folds: int, cuts: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per column the number of values by fold (one more for other numbers) and interval."""

    def count(batches):
        import pyarrow as pa

        n = [np.zeros((folds + 1) * (len(at) + 1), np.int64) for at in cuts]
        for batch in batches:
            for c, _, own, i in _placed(batch, cuts, folds):
                n[c] += np.bincount(own * (len(cuts[c]) + 1) + i, minlength=len(n[c]))
        yield pa.RecordBatch.from_pydict({"_c": pa.array(range(len(n)), pa.int32()), "n": pa.array([x.tobytes() for x in n], pa.binary())})

    def add(table):
        import pyarrow as pa

        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table["n"])
        return pa.table({"_c": table["_c"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    found = _typed(df, columns).mapInArrow(count, "_c int, n binary").groupBy("_c").applyInArrow(add, "_c int, n binary").collect()
    out = [np.zeros((folds + 1, len(at) + 1), np.int64) for at in cuts]
    for r in found:
        out[r["_c"]] = np.frombuffer(bytes(r["n"]), np.int64).reshape(folds + 1, -1)
    return out


def training(counts: np.ndarray, folds: int) -> np.ndarray:
    """Values that train each fold, by interval: all less its own."""
    return counts.sum(axis=0) - counts[:folds]


def holding(train: np.ndarray, bins: int, at: Sequence[int]) -> np.ndarray:
    """The intervals with the neighbours of a quantile i/bins, i in `at`, of some fold: ranks floor and ceil of (n-1)(i/bins), with some room for rounding."""
    found = np.zeros(train.shape[1], bool)
    for own in train:
        upto, n = np.cumsum(own), int(own.sum())
        if n:
            place = (n - 1) * (np.asarray(at) / bins)
            ranks = np.clip(np.concatenate([np.floor(place) - 1, np.floor(place), np.ceil(place), np.ceil(place) + 1]), 0, n - 1)
            found[np.searchsorted(upto, ranks, side="right")] = True
    return found


def value_counts(df: DataFrame, columns: Sequence[str], folds: int, cuts: Sequence[np.ndarray], wanted: Sequence[np.ndarray]) -> DataFrame:
    """(_c, _span, _v, _m0, _m1, ...): the values of the wanted intervals and how often each trains every fold."""
    names = [f"_m{k}" for k in range(folds)]

    def pick(batches):
        import pyarrow as pa

        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in cuts]
        size = 0

        def counts() -> Iterator:
            for c, parts in enumerate(held):
                if not parts:
                    continue
                v, own, i = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                distinct, first, which = np.unique(v + 0.0, return_index=True, return_inverse=True)  # -0 is 0
                n = np.bincount(which * (folds + 1) + own, minlength=len(distinct) * (folds + 1)).reshape(len(distinct), folds + 1)
                train = n.sum(axis=1, keepdims=True) - n[:, :folds]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(distinct), c, np.int32)), pa.array(i[first].astype(np.int32)), pa.array(distinct), *[pa.array(train[:, k]) for k in range(folds)]], ["_c", "_span", "_v", *names]
                )

        for batch in batches:
            for c, v, own, i in _placed(batch, cuts, folds):
                keep = wanted[c][i]
                if keep.any():
                    held[c].append((v[keep], own[keep], i[keep]))
                    size += int(keep.sum())
            if size > 4_000_000:
                yield from counts()
                size = 0
        yield from counts()

    rows = _typed(df, columns).mapInArrow(pick, "_c int, _span int, _v double, " + ", ".join(f"{n} long" for n in names))
    return rows.groupBy("_c", "_span", "_v").agg(*[F.sum(n).alias(n) for n in names])
