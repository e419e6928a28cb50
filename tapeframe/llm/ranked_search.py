"""Ranked search with bounds of term pairs (MaxScore over precomputed intersections).

The index is a map over the scan: every task cuts its rows into shards of about `shard_bytes` of text and writes one file a shard, with
posting lists of (row, impact) by term. Impacts need two numbers of the whole collection, N and L, which one pass before counts. For
the frequent terms of a shard (in at least one row of 32, the `common` most frequent of them) the file also holds pairs:
the corners of all (impact, impact) points that rows with both terms have, from which the joint maximum under any two weights follows,
and, where it is short, the list of these rows.

A query is ranked per shard. Its terms are taken in descending order of their maxima; once no row that lacks all terms so far
can reach the k-th best score, only rows seen so far are completed, and rows drop out as soon as what is left can't lift them.
What is left is bounded by pairs: two terms together give at most the greater of their maxima and their joint maximum. If
only rows of some pair lists could still get in, these rows join the candidates and the terms' own lists are skipped. Bounds only skip
work: rows that can tie with the k-th are kept, so results are those of scoring everything.

Queries are cut into blocks of bounded size, kept in files; a shard task goes through all blocks, so nothing of the queries
or the collection passes through the driver but file names. Each shard gives at most k rows a query; the last rank takes k a task first.

Null texts and texts without terms are in no list and count in no N. A query without terms has no rows. Equal scores rank by ascending
id, null ids last. Repeated rows and repeated queries rank each on its own. Terms are compared by 64-bit hashes. Other columns are
not looked at. An empty table of either kind gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import folder_uri, open_file, read_file, stored, write_file
from .terms import hashed, separators
from .textbytes import buffers, chunks, words

CUT = separators(inside=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SECTIONS = ("terms", "ends", "rows", "impacts", "ids", "nulls", "pair_keys", "corner_ends", "corners", "list_ends", "lists")


@dataclass(frozen=True)
class Collection:
    documents: int  # N
    terms: int  # L


def collection(docs: DataFrame, *, text: str = "text") -> Collection:
    """N and L of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for _, _, part, at in chunks(raw, offsets):
                _, _, row = words(part, at, CUT)
                total += len(row)
                n += np.count_nonzero(np.diff(row)) + (len(row) > 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    found = docs.select(docs[text].alias("text")).mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return Collection(found["n"] or 0, found["total"] or 0)


def impacts(tf: np.ndarray, length: np.ndarray, of: Collection) -> np.ndarray:
    """The weight-free part of a posting's score, in 64-bit integers."""
    m = 100 - 50 + (50 * length * of.documents) // max(1, of.terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def corners(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The points of which one is greatest under any weights of a and b that aren't negative."""
    order = np.lexsort((-b, -a))
    a, b = a[order], b[order]
    best = np.maximum.accumulate(b)
    keep = np.concatenate([[True], b[1:] > best[:-1]])[: len(b)]
    hull: list[tuple[int, int]] = []
    for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
        while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (y - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (x - hull[-2][0]) <= 0:
            hull.pop()
        hull.append((x, y))
    return hull


def _ends(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def shard_arrays(h: np.ndarray, row: np.ndarray, ids: np.ndarray, nulls: np.ndarray, of: Collection, *, common: int, rare_list: int = 8) -> dict[str, np.ndarray]:
    """The index of one shard from the hashes of its terms and their rows (ascending)."""
    rows = len(ids)
    length = np.bincount(row, minlength=rows)
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)])
    tf = np.diff(np.append(new, len(h)))
    posting_rows, posting_terms = row[new], h[new]
    impact = impacts(tf, length[posting_rows], of)
    first = np.flatnonzero(np.concatenate([[True], posting_terms[1:] != posting_terms[:-1]])[: len(new)])
    ends = np.append(first, len(new))

    sizes = np.diff(ends)
    frequent = np.flatnonzero(sizes >= max(2, rows / 32))
    frequent = np.sort(frequent[np.argsort(-sizes[frequent], kind="stable")][:common])
    dense = np.zeros((len(frequent), rows), np.int64)
    for i, t in enumerate(frequent):
        dense[i, posting_rows[ends[t] : ends[t + 1]]] = impact[ends[t] : ends[t + 1]]
    keys, points, point_sizes, lists, list_sizes = [], [], [], [], []
    for i in range(len(frequent)):
        mine = np.flatnonzero(dense[i])
        for j in range(i + 1, len(frequent)):
            other = dense[j, mine]
            both = mine[other > 0]
            found = corners(dense[i, both], dense[j, both]) if len(both) else []
            keys.append(int(frequent[i]) << 32 | int(frequent[j]))
            points += found
            point_sizes.append(len(found))
            short = len(both) * rare_list <= rows
            lists.append(both if short else both[:0])
            list_sizes.append(len(both) if short else -1)
    listed = np.array(list_sizes, np.int64)
    return {
        "terms": posting_terms[first],
        "ends": ends.astype(np.int64),
        "rows": posting_rows.astype(np.uint32),
        "impacts": impact.astype(np.uint32),
        "ids": ids,
        "nulls": nulls,
        "pair_keys": np.array(keys, np.int64),
        "corner_ends": _ends(point_sizes),
        "corners": np.array(points, np.int64).reshape(-1, 2).astype(np.uint32).ravel(),
        "list_ends": np.stack([_ends(np.maximum(listed, 0).tolist())[:-1], listed], 1).ravel(),
        "lists": np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.uint32),
    }


_TYPES = {"terms": "<u8", "rows": "<u4", "impacts": "<u4", "nulls": "?", "corners": "<u4", "lists": "<u4"}


def _written(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Sections one behind the other, each compressed by itself, after a table of their sizes."""
    parts = [zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(arrays[s].astype(_TYPES.get(s, "<i8"), copy=False)).tobytes()) for s in SECTIONS]
    return write_file(folder, "shard", np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts))


def _section(data: bytes, name: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(data), _TYPES.get(name, "<i8"))


class Shard:
    """A shard's file; sections are read when they are first asked for."""

    def __init__(self, uri: str):
        self._file = open_file(uri)
        sizes = np.frombuffer(self._file.read_at(8 * len(SECTIONS), 0), "<i8")
        starts = 8 * len(SECTIONS) + np.cumsum(sizes) - sizes
        self._at = {s: (int(n), int(a)) for s, n, a in zip(SECTIONS, sizes, starts, strict=True)}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in SECTIONS:
            raise AttributeError(name)
        found = _section(self._file.read_at(*self._at[name]), name)
        setattr(self, name, found)
        return found

    @cached_property
    def maxima(self) -> np.ndarray:
        return np.maximum.reduceat(self.impacts, self.ends[:-1]).astype(np.int64) if len(self.terms) else np.zeros(0, np.int64)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in the shard, -1 for none."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[self.ends[t] : self.ends[t + 1]], self.impacts[self.ends[t] : self.ends[t + 1]].astype(np.int64)

    def pairs(self, t: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(i, j, joint maximum, rows or None) of those pairs of the query's terms that the index has."""
        i, j = np.triu_indices(len(t), 1)
        lo, hi = np.minimum(t[i], t[j]), np.maximum(t[i], t[j])
        key = lo << 32 | hi
        if not len(self.pair_keys) or not len(key):
            return
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        for x in np.flatnonzero(self.pair_keys[at] == key).tolist():
            p, a, b = int(at[x]), int(i[x]), int(j[x])
            points = self.corners[2 * self.corner_ends[p] : 2 * self.corner_ends[p + 1]].reshape(-1, 2).astype(np.int64)
            first, second = (a, b) if t[a] < t[b] else (b, a)
            joint = int((points @ np.array([w[first], w[second]])).max(initial=0))
            start, size = self.list_ends[2 * p], self.list_ends[2 * p + 1]
            yield a, b, joint, self.lists[start : start + size] if size >= 0 else None


@dataclass
class Work:
    """What a search did, for tests and tuning."""

    postings: int = 0  # of the query's terms
    read: int = 0  # whose scores were added
    pair_lists: int = 0  # rows taken from pair lists


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best rows and all that tie with the last, score above 0, in no order."""
    work = work or Work()
    none = np.zeros(0, np.int64)
    t = shard.places(terms)
    t, w = t[(t >= 0) & (weights > 0)], weights[(t >= 0) & (weights > 0)]
    if not len(t):
        return none, none
    top = w * shard.maxima[t]
    order = np.argsort(-top, kind="stable")
    t, w, top = t[order], w[order], top[order]
    work.postings += int((shard.ends[t + 1] - shard.ends[t]).sum())

    # disjoint pairs by what they take off the bound; a pair counts for the terms from p on if both are among them
    found = sorted(((int(top[a] + top[b]) - max(int(top[a]), int(top[b]), joint), a, b, joint, rows) for a, b, joint, rows in shard.pairs(t, w)), key=lambda x: x[:3], reverse=True)
    used: set[int] = set()
    gain, gain_apart = np.zeros(len(t) + 1, np.int64), np.zeros(len(t) + 1, np.int64)
    chosen: list[tuple[int, np.ndarray | None]] = []
    for saved, a, b, _, rows in found:
        if saved > 0 and a not in used and b not in used:
            used |= {a, b}
            gain[min(a, b)] += saved
            gain_apart[min(a, b)] += min(int(top[a]), int(top[b])) if rows is not None else saved
            chosen.append((min(a, b), rows))
    rest = np.append(np.cumsum(top[::-1])[::-1], 0)
    bound = rest - np.cumsum(gain[::-1])[::-1]  # of the terms from p on
    apart = rest - np.cumsum(gain_apart[::-1])[::-1]  # the same for rows in none of the pair lists

    scores = np.zeros(len(shard.ids), np.int64)
    seen = np.zeros(len(shard.ids), bool)
    least, p, candidates = 0, 0, None
    while p < len(t):
        if least > bound[p]:
            candidates = np.flatnonzero(seen & (scores + bound[p] >= least))
            break
        if least > apart[p]:
            lists = [rows for first, rows in chosen if first >= p and rows is not None]
            size = sum(map(len, lists))
            if size <= (shard.ends[t[p:] + 1] - shard.ends[t[p:]]).sum() // 2:
                work.pair_lists += size
                seen[np.concatenate([*lists, none]).astype(np.int64)] = True
                candidates = np.flatnonzero(seen & (scores + bound[p] >= least))
                break
        rows, impact = shard.postings(int(t[p]))
        work.read += len(rows)
        scores[rows] += w[p] * impact
        seen[rows] = True
        p += 1
        if p < len(t) and scores.max() > min(bound[p], apart[p]):
            now = scores[seen]
            if len(now) >= k:
                least = int(np.partition(now, len(now) - k)[len(now) - k])
    if candidates is None:
        candidates = np.flatnonzero(seen)
    got = scores[candidates]
    while p < len(t) and len(candidates):
        rows, impact = shard.postings(int(t[p]))
        at = np.minimum(np.searchsorted(rows, candidates), len(rows) - 1)
        hit = rows[at] == candidates
        work.read += int(hit.sum())
        got[hit] += w[p] * impact[at[hit]]
        p += 1
        if len(got) >= k:
            least = max(least, int(np.partition(got, len(got) - k)[len(got) - k]))
        alive = got + bound[p] >= least
        candidates, got = candidates[alive], got[alive]
    if len(got) > k:
        least = int(np.partition(got, len(got) - k)[len(got) - k])
        candidates, got = candidates[got >= least], got[got >= least]
    return candidates[got > 0], got[got > 0]


def build_index(docs: DataFrame, of: Collection, *, key: str = "doc_id", text: str = "text", shard_bytes: int = 16 << 20, common: int = 48) -> DataFrame:
    """(uri): a file per shard. A map over the scan; a text longer than `shard_bytes` is a shard by itself."""
    folder = folder_uri(docs.sparkSession, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, row, ids, nulls = (np.concatenate(x) for x in zip(*held, strict=True))
                uri = _written(folder, shard_arrays(h, row, ids, nulls, of, common=common))
                yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])
                held.clear()

        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            key_column = batch.column(0)
            ids, nulls = key_column.fill_null(np.iinfo(np.int64).max).to_numpy(), key_column.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, part, at in chunks(raw, offsets):
                if size and size + len(part) > shard_bytes:
                    yield from flush()
                    size = rows = 0
                h, _, _, row = hashed(part, at, CUT)
                held.append((h, row + rows, ids[lo:hi], nulls[lo:hi]))
                size, rows = size + len(part) + hi - lo, rows + hi - lo
        yield from flush()

    return stored(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, "uri string"), "shards")


def _block(data: bytes) -> tuple[np.ndarray, ...]:
    """(ids, null ids, ends of their terms, terms, places of the terms in `distinct`, distinct terms)."""
    sizes = np.frombuffer(data, "<i8", 2)
    n, m = int(sizes[0]), int(sizes[1])
    ids = np.frombuffer(data, "<i8", n, 16)
    nulls = np.frombuffer(data, "?", n, 16 + 8 * n)
    ends = np.frombuffer(data, "<i8", n + 1, 16 + 9 * n)
    terms = np.frombuffer(data, "<u8", m, 24 + 17 * n)
    distinct, of = np.unique(terms, return_inverse=True)
    return ids, nulls, ends, terms, of, distinct


def query_blocks(queries: DataFrame, *, key: str, text: str = "text") -> list[str]:
    """Files of the queries' different terms, for about as much text as a chunk has. Only their names come to the driver."""
    folder = folder_uri(queries.sparkSession, "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            key_column = batch.column(0)
            ids, nulls = key_column.fill_null(0).to_numpy(), key_column.is_null().to_numpy(zero_copy_only=False)
            for lo, hi, part, at in chunks(raw, offsets):
                h, _, _, row = hashed(part, at, CUT)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
                h, row = h[new], row[new]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                data = np.array([hi - lo, len(h)], "<i8").tobytes() + ids[lo:hi].astype("<i8").tobytes() + nulls[lo:hi].tobytes() + ends.astype("<i8").tobytes() + h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([write_file(folder, "block", data)])], ["uri"])

    found = queries.select(queries[key].cast("long").alias("key"), queries[text].alias("text")).mapInArrow(run, "uri string")
    return sorted(r["uri"] for r in stored(found, "blocks").collect())


def _dealt(shards: DataFrame) -> DataFrame:
    """Small rows that stand for much work each, dealt to as many tasks as there are."""
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.repartition(max(1, min(shards.count(), max(parts, shards.sparkSession.sparkContext.defaultParallelism))))


def query_weights(shards: DataFrame, blocks: list[str], of: Collection) -> list[str]:
    """A file per block with the weight of each of its different terms, from the documents that hold it in all shards."""
    spark = shards.sparkSession
    folder = folder_uri(spark, "weights")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uris = [u for batch in batches for u in batch.column(0).to_pylist()]
        if not uris:
            return
        for b, uri in enumerate(blocks):
            distinct = _block(read_file(uri))[-1]
            df = np.zeros(len(distinct), np.int64)
            for u in uris:
                shard = Shard(u)
                at = shard.places(distinct)
                has = at >= 0
                df[has] += shard.ends[at[has] + 1] - shard.ends[at[has]]
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b), pa.int32()), pa.array(some), pa.array(df[some])], ["block", "place", "df"])

    def weigh(table: pa.Table) -> pa.Table:
        b = table.column("block")[0].as_py()
        w = np.zeros(len(_block(read_file(blocks[b]))[-1]), "<i8")
        w[table.column("place").to_numpy()] = [math.floor(1000 * math.log((2 * of.documents + 2) / (2 * n + 1))) for n in table.column("df").to_pylist()]
        return pa.table({"block": pa.array([b], pa.int32()), "uri": [write_file(folder, "weights", w.tobytes())]})

    counts = _dealt(shards).mapInArrow(count, "block int, place long, df long").groupBy("block", "place").agg(F.sum("df").alias("df"))
    written = stored(counts.groupBy("block").applyInArrow(weigh, "block int, uri string"), "weights")
    found = {r["block"]: r["uri"] for r in written.collect()}
    return [found.get(b, "") for b in range(len(blocks))]


def ranked(docs: DataFrame, queries: DataFrame, *, key: str = "doc_id", query_key: str = "item_id", text: str = "text", k: int = 50, shard_bytes: int = 16 << 20, common: int = 48) -> DataFrame:
    """Per query its k best rows: query_key, rank (from 1), key, score."""
    of = collection(docs, text=text)
    shards = build_index(docs, of, key=key, text=text, shard_bytes=shard_bytes, common=common)
    blocks = query_blocks(queries, key=query_key, text=text)
    weights = query_weights(shards, blocks, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = []
        for uri, weighed in zip(blocks, weights, strict=True):
            if weighed:
                loaded.append((len(loaded), _block(read_file(uri)), np.frombuffer(read_file(weighed), "<i8")))
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                shard = Shard(uri)
                for number, (ids, nulls, ends, _, place, distinct), w in loaded:
                    out = []
                    for q in range(len(ids)):
                        mine = place[ends[q] : ends[q + 1]]
                        rows, scores = search(shard, distinct[mine], w[mine], k)
                        best = np.lexsort((shard.ids[rows], shard.nulls[rows], -scores))[:k]
                        out.append((np.full(len(best), q), rows[best], scores[best]))
                    q, rows, scores = (np.concatenate(x) for x in zip(*out, strict=True))
                    columns = [
                        pa.array((number << 32) + q.astype(np.int64)),
                        pa.array(ids[q], mask=nulls[q]),
                        pa.array(shard.ids[rows], mask=shard.nulls[rows]),
                        pa.array(scores),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "q", "d", "score"])

    found = stored(_dealt(shards).mapInArrow(run, "query long, q long, d long, score long"), "ranked")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("d"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select(F.col("q").alias(query_key), "rank", F.col("d").alias(key), "score")
