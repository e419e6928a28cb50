"""Token ids in shards, each a wavelet matrix: one bit-plane per bit of an id, with counts for rank and select.

A shard is one file: a header (JSON), the rows' ids and lengths, then the planes, the highest bit first. In each
plane the ids that have the bit unset go before the others, in stable order, so that one file answers
access(i), count(id, i) and the place of the k-th occurrence, and gives back the whole sequence. Planes are
compressed in blocks; single questions inflate only the blocks they touch.

Rows are dealt to partitions by ranges of the key and sorted, so shards follow each other in key order; a
partition of more than shard_tokens ids has several. Null and empty texts have the end mark alone. Rows with a
null key come first. Equal keys are kept, in any order among each other. An empty table gives no shard.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpe
from .storage import folder_uri, open_file, read_file, stored, write_file
from .textbytes import buffers, chunks

MAGIC = b"WVMX0001"
BLOCK = 1 << 16  # bytes of a plane that are compressed together
SHARD_TOKENS = 1 << 20


def pack_shard(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of one shard; keys and lengths have a value per row, ids all rows' ids in order."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    press = zstandard.ZstdCompressor(level=1)
    planes, parts = [], []
    for bit in range(bits - 1, -1, -1):
        on = (values & values.dtype.type(1 << bit)) != 0
        packed = np.packbits(on).tobytes()
        blocks = [packed[i : i + BLOCK] for i in range(0, len(packed), BLOCK)]
        pressed = [press.compress(b) for b in blocks]
        ones = [int(np.count_nonzero(on[i * BLOCK * 8 : (i + 1) * BLOCK * 8])) for i in range(len(blocks))]
        planes.append({"zeros": int(len(values) - sum(ones)), "ones": ones, "sizes": [len(b) for b in pressed]})
        parts += pressed
        values = np.concatenate([np.compress(~on, values), np.compress(on, values)])
    rows = press.compress(keys.astype("<i8").tobytes() + lengths.astype("<i8").tobytes())
    head = json.dumps({"rows": len(keys), "tokens": len(ids), "bits": bits, "row_bytes": len(rows), "planes": planes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, rows, *parts])


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lengths, ids) of a whole file, planes undone from the lowest bit up."""
    head, at = _header(data)
    inflate = zstandard.ZstdDecompressor()
    table = np.frombuffer(inflate.decompress(data[at : at + head["row_bytes"]], max_output_size=16 * head["rows"] + 1), "<i8")
    at += head["row_bytes"]
    n, starts = head["tokens"], []
    for plane in head["planes"]:
        starts.append(at)
        at += sum(plane["sizes"])
    values = np.zeros(n, np.uint16 if head["bits"] <= 16 else np.uint32)
    for bit, (plane, at) in enumerate(zip(reversed(head["planes"]), reversed(starts), strict=True)):
        packed = []
        for size in plane["sizes"]:
            packed.append(inflate.decompress(data[at : at + size], max_output_size=BLOCK))
            at += size
        on = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8), count=n).astype(bool)
        before = np.empty_like(values)
        before[np.flatnonzero(~on)] = values[: plane["zeros"]]
        before[np.flatnonzero(on)] = values[plane["zeros"] :] | values.dtype.type(1 << bit)
        values = before
    return table[: head["rows"]], table[head["rows"] :], values


def _header(data: bytes) -> tuple[dict, int]:
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    (size,) = struct.unpack("<I", data[8:12])
    return json.loads(data[12 : 12 + size]), 12 + size


class Shard:
    """Questions to one shard file without inflating all of it."""

    def __init__(self, uri: str):
        self.src = open_file(uri)
        first = self.src.read(12)
        (size,) = struct.unpack("<I", first[8:12])
        self.head, at = _header(first + self.src.read(size))
        self.rows_at = at
        at += self.head["row_bytes"]
        self.tokens, self.bits, self.planes = self.head["tokens"], self.head["bits"], []
        for p in self.head["planes"]:
            sizes = np.array(p["sizes"], np.int64)
            self.planes.append((p["zeros"], np.concatenate([[0], np.cumsum(p["ones"])]), at + np.concatenate([[0], np.cumsum(sizes)])))
            at += int(sizes.sum())
        self.block = functools.lru_cache(maxsize=64)(self._block)

    def _block(self, plane: int, i: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bits, and the ones before each of its 512-bit words."""
        where = self.planes[plane][2]
        self.src.seek(int(where[i]))
        raw = zstandard.ZstdDecompressor().decompress(self.src.read(int(where[i + 1] - where[i])), max_output_size=BLOCK)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8))
        per_word = np.add.reduceat(bits, np.arange(0, len(bits), 512), dtype=np.int64)
        return bits, np.concatenate([[0], np.cumsum(per_word)])

    def bit(self, plane: int, i: int) -> int:
        return int(self.block(plane, i // (BLOCK * 8))[0][i % (BLOCK * 8)])

    def ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        which, rest = divmod(i, BLOCK * 8)
        before = int(self.planes[plane][1][which])
        if not rest:
            return before
        bits, counted = self.block(plane, which)
        word = rest // 512
        return before + int(counted[word]) + int(bits[word * 512 : rest].sum())

    def select(self, plane: int, value: int, k: int) -> int:
        """Place of the k-th (from 0) bit with this value."""
        of = (lambda i: self.ones(plane, i)) if value else (lambda i: i - self.ones(plane, i))
        lo, hi = 0, self.tokens
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if of(mid + 1) <= k else (lo, mid)
        return lo

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for plane in range(self.bits):
            on = self.bit(plane, i)
            out = out * 2 + on
            i = self.planes[plane][0] + self.ones(plane, i) if on else i - self.ones(plane, i)
        return out

    def _down(self, token: int, i: int) -> tuple[int, int]:
        """Where the ids equal to token among the first i end up below the last plane: from, to."""
        if token < 0 or token >> self.bits:
            return 0, 0
        lo, hi = 0, i
        for plane in range(self.bits):
            a, b = self.ones(plane, lo), self.ones(plane, hi)
            if token >> (self.bits - 1 - plane) & 1:
                lo, hi = self.planes[plane][0] + a, self.planes[plane][0] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """How often token stands among the first end ids (all by default)."""
        lo, hi = self._down(token, self.tokens if end is None else min(end, self.tokens))
        return hi - lo

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of token."""
        lo, hi = self._down(token, self.tokens)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for plane in range(self.bits - 1, -1, -1):
            on = token >> (self.bits - 1 - plane) & 1
            i = self.select(plane, on, i - self.planes[plane][0] if on else i)
        return i


def write_shards(docs: DataFrame, path: str | None = None, *, end_id: int = 2, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes all texts, appends end_id to each and writes them in ascending key order. Returns the committed
    table of shards: partition, shard, uri, rows, tokens. One shuffle, of key and text by key range."""
    path = path or bpe.default_path()
    spark = docs.sparkSession
    folder = folder_uri(spark, "token-shards")
    picked = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.library_encoder(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        state = {"tokens": 0, "shard": 0, "partition": None}

        def flush() -> pa.RecordBatch:
            keys, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{state['partition']:06d}-{state['shard']:06d}"
            row = [state["partition"], state["shard"], write_file(folder, name, pack_shard(keys, lengths, ids)), len(keys), len(ids)]
            held.clear()
            state["tokens"], state["shard"] = 0, state["shard"] + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["partition", "shard", "uri", "rows", "tokens"])

        for batch in batches:
            keys = np.asarray(batch.column(0).fill_null(-(2**63)))
            state["partition"] = batch.column(2)[0].as_py() if len(batch) else state["partition"]
            raw, offsets = buffers(batch.column(1))
            for lo, hi, part, at in chunks(raw, offsets, bpe.CHUNK):
                ids, rows = bpe.encode(encoder, part, at)
                ids, ends = with_end(ids, rows, end_id)
                held.append((keys[lo:hi], np.diff(ends), ids))
                state["tokens"] += len(ids)
                if state["tokens"] >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = picked.repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("partition", F.spark_partition_id())
    return stored(dealt.mapInArrow(run, "partition long, shard long, uri string, rows long, tokens long"), "token-shards-table")


def with_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id behind each row, and the new ends."""
    out = np.empty(len(ids) + len(rows) - 1, np.int32)
    ends = rows + np.arange(len(rows))
    last = np.zeros(len(out), bool)
    last[ends[1:] - 1] = True
    out[last], out[~last] = end_id, ids
    return out, ends


def with_starts(shards: DataFrame) -> DataFrame:
    """Adds start: ids in all shards before. Sums per partition come first, so the running sum over everything
    has one row per partition, of which there are spark.sql.shuffle.partitions at most."""
    sums = shards.groupBy("partition").agg(F.sum("tokens").alias("t"))
    before = W.orderBy("partition").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("partition", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("partition").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    inner = shards.withColumn("inner", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    return inner.join(F.broadcast(sums), "partition").withColumn("start", F.col("base") + F.col("inner")).drop("base", "inner")


def read_rows(shards: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per row, from the files: key, start, n_tokens, ids_crc32 (over the ids as little-endian 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                keys, lengths, ids = unpack_shard(read_file(uri))
                ends = np.concatenate([[0], np.cumsum(lengths)])
                wide = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == -(2**63)), pa.array(start + ends[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    listed = with_starts(shards).select("uri", "start")
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(n).mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
