"""Bloom filters of a fixed size, made where the keys are and handed to every task.

The size is a parameter and the proof of the broadcast's bound; more keys only make the filter less selective, never wrong
in what it lacks. Keys are 64-bit hashes: their highest bits name the segment of the filter, so that every
segment is made by one task from the keys that are dealt to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mix

SEGMENTS = 64
PROBES = 3


def places(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The place of each key for a probe, within a filter of this many bits (a multiple of 8 x SEGMENTS): the segment comes
    from the key, the place inside it from a hash."""
    inside = bits // SEGMENTS
    h = mix(keys + np.uint64((0x9E3779B97F4A7C15 * (probe + 1)) % (1 << 64)))
    return ((keys >> np.uint64(58)) * np.uint64(inside) + ((h >> np.uint64(32)) * np.uint64(inside) >> np.uint64(32))).astype(np.int64)


def build(keys: DataFrame, column: str, *, bits: int = 1 << 26) -> np.ndarray:
    """The filter over a long column, as bytes: bits / 8 of them reach the driver, whatever the input's size. Null keys are left out."""
    inside = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            segment = (k >> np.uint64(58)).astype(np.int64)
            for s in np.unique(segment).tolist():
                part = own.setdefault(s, np.zeros(inside, bool))
                some = k[segment == s]
                for probe in range(PROBES):
                    part[places(some, bits, probe) - s * inside] = True
        for s, part in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["segment", "bits"])

    listed = keys.select(F.col(column).cast("long").alias("k")).where("k is not null")
    dealt = listed.repartition(SEGMENTS, F.shiftrightunsigned("k", 58))
    out = np.zeros(bits // 8, np.uint8)
    # one job; what it returns is at most one part of the fixed size per segment
    for row in dealt.mapInArrow(run, "segment int, bits binary").collect():
        at = row["segment"] * inside // 8
        out[at : at + inside // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def holds(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; keys that were put in always are."""
    bits = len(filled) * 8
    out = np.ones(len(keys), bool)
    for probe in range(PROBES):
        at = places(keys, bits, probe)
        out &= (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
