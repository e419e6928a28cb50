"""Piecewise linear encodings, a batch of values at a time.

The numbers of all bins of a batch lie in one array, value by value; only the edges come in and what the query keeps goes out. Functions of one
encoding (`totals`) run in the same pass, so an encoding that is only summed never leaves it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .arrays import both, vector


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(lengths, all elements, which of them are values, which lists are there)."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, *vector(column.flatten()), there


def _encode(x: pa.Array, edges: pa.Array) -> pa.Array:
    lengths, e, is_edge, there = _lists(edges)
    if (there & (lengths == 0)).any():
        raise ValueError("a list of edges is empty")
    bins = np.maximum(lengths - 1, 0)
    ends = np.cumsum(bins)
    i = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - bins, bins)
    at = np.repeat(np.cumsum(lengths) - lengths, bins) + i
    value, is_value = vector(x.cast(pa.float64()))
    low, high = e[at], e[at + 1]
    width = high - low
    defined = both(None if is_value is None else np.repeat(is_value, bins), None if is_edge is None else is_edge[at] & is_edge[at + 1], None if width.all() else width != 0)
    with np.errstate(all="ignore"):
        t = (np.repeat(value, bins) - low) / width
    first, last = i == 0, i == np.repeat(bins - 1, bins)
    t = np.where(first, t, np.maximum(t, 0.0))
    t = np.where(last, t, np.fmin(t, 1.0))
    null = None
    if defined is not None:  # bounds hold where there is no number to bound
        t = np.where(defined, t, np.where(first & ~last, 1.0, 0.0))
        null = ~defined & first & last
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=None if there.all() else np.append(~there, False))
    return pa.ListArray.from_arrays(offsets, pa.array(t, mask=null))


def _sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    some = lengths > 0
    out = np.zeros(len(lengths))
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def _add_up(encodings: pa.Array) -> pa.Array:
    lengths, v, is_value, there = _lists(encodings)
    place = np.arange(len(v)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
    whole = there if is_value is None else there & (_sum((~is_value).astype(np.float64), lengths) == 0)
    number = lambda x, ok, kind: pa.array(x, kind, mask=None if ok.all() else ~ok)
    columns = [number(lengths, there, pa.int32()), number(_sum(v, lengths), whole, pa.float64()), number(_sum(v * place, lengths), whole, pa.float64())]
    return pa.StructArray.from_arrays(columns, ["bins", "total", "moment"])


@F.arrow_udf(ArrayType(DoubleType()))
def encoding(x: pa.Array, edges: pa.Array) -> pa.Array:
    return _encode(x, edges)


@F.arrow_udf(StructType([StructField("bins", IntegerType()), StructField("total", DoubleType()), StructField("moment", DoubleType())]))
def totals(encodings: pa.Array) -> pa.Array:
    """Number of bins, sum and first moment (bins count from 1) of an encoding; sums with a null are null."""
    return _add_up(encodings)
