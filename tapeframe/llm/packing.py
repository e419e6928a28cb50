"""Best-fit packing of token pieces into sequences, by a tree of residual rounds.

A document's ids, with the end id behind, are cut from the end into pieces of `capacity`; only the first may
be shorter. Full pieces are sequences already. The shorter ones are dealt to partitions and packed there by
best-fit decreasing; nearly full bins are sequences, the pieces of the others are dealt anew in the next round,
on fewer partitions, and so on up the tree (one by one, as of two underfull bins hardly ever one is at most half full).
No task gets more than about `task_items` items, also at the root: a round on one task closes all that is left, and so
does a round after one that hardly closed bins, if there can't be fewer partitions.

A bin carries its members (at most `capacity` of them, as each has an id at least), so no row is looked up
again. Null and empty texts have one piece, the end id. Equal documents are packed each on their own. An empty table gives no
sequence. Sequence ids are numbers without meaning.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .storage import stored
from .textbytes import buffers, chunks
from .wavelet import with_end

PIECE = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"


def token_pieces(docs: DataFrame, path: str | None = None, *, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A map over the scan."""
    path = path or bpe.default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_encoder(path)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for lo, hi, part, at in chunks(raw, offsets, bpe.CHUNK):
                ids, ends = with_end(*bpe.encode(encoder, part, at), end_id)
                sizes = np.diff(ends)
                counts = -(-sizes // capacity)
                row = np.repeat(np.arange(hi - lo), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                short = (sizes - 1) % capacity + 1  # of the first piece
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                wide = memoryview(ids.astype("<u4").tobytes())
                first = ends[row] + start
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)

    picked = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each bin's items. A bit set of the room left finds the tightest bin at once."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0
    for i in order:
        n = sizes[i]
        fitting = rooms >> n
        if fitting:
            room = n + ((fitting & -fitting).bit_length() - 1)
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - n:
            open_bins[left].append(b)
            rooms |= 1 << left
    return bins


def _round(capacity: int, enough: int, last: bool):
    """Packs the items of a partition; items have total and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        totals = table.column("total").to_numpy()
        members = table.column("members").chunk(0)
        bins = best_fit(totals, capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(totals))
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        lists = members.take(pa.array(order))
        flat = lists.flatten()
        counts = lists.value_lengths().to_numpy()
        sums = np.bincount(of, totals[order], len(bins)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, counts, len(bins)).astype(np.int64))])
        out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat)
        done = (sums >= enough) | last
        yield pa.RecordBatch.from_arrays([pa.array(sums), out, pa.array(done)], ["total", "members", "done"])

    return run


def _member():
    return F.struct("doc_id", "piece", "start", "length", "ids_crc32").cast(PIECE).alias("m")


def short_items(pieces: DataFrame, capacity: int) -> DataFrame:
    """(total, members): the pieces that do not fill a sequence, each an item."""
    return pieces.where(F.col("length") < capacity).select(F.col("length").alias("total"), F.array(_member()).alias("members"))


def dealt(items: DataFrame, parts: int) -> DataFrame:
    """Items in turn to all partitions, so that equal ones spread too. Items come from a stored table."""
    return items.repartition(parts)


def pack(pieces: DataFrame, *, capacity: int = 1024, nearly_full: float = 0.995, fan_in: int = 8, task_items: int = 50_000) -> DataFrame:
    """Per piece: its columns, sequence_id and offset. pieces has doc_id, piece, start, length, ids_crc32 with
    1 <= length <= capacity; it is read twice, so hand over a table that is stored."""
    spark = pieces.sparkSession
    items = short_items(pieces, capacity)
    count, closed, before, was = items.count(), [], None, None
    parts = max(1, -(-count // task_items))
    parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 2_000)))
    while count:
        last = parts == 1 or (parts == was and count > 0.98 * before)
        enough = int(capacity * nearly_full)
        packed = stored(dealt(items, parts).mapInArrow(_round(capacity, enough, last), f"total long, members array<{PIECE}>, done boolean"), "bins")
        closed.append(packed.where("done").select("members"))
        if last:
            break
        items = packed.where("not done").select(F.explode("members").alias("m")).select(F.col("m.length").alias("total"), F.array("m").alias("members"))
        before, was, count = count, parts, items.count()
        parts = min(was, max(1, -(-count // task_items), -(-was // fan_in)))
    full = pieces.where(F.col("length") == capacity).select(F.array(_member()).alias("members"))
    bins = full
    for b in closed:
        bins = bins.unionByName(b)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    before_it = F.expr("transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))")
    rows = bins.select("sequence_id", F.explode(before_it).alias("p"))
    return rows.select("p.m.*", "sequence_id", F.col("p.offset").alias("offset"))
