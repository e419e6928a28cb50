"""Similarity join of shingle sets by parity sketches.

A set's sketch has one word per part of the shingle space: the XOR of the hashes of its shingles there. A shingle that only one of two
sets has changes one word, so the number of differing words (the sketches' Hamming distance) is at most the symmetric
difference. For a link, num/den of the union is shared, so sets of sizes a and b differ in at most (a+b)(den-num)/(den+num)
shingles. Sizes are cut into bands such that linked sets lie in the same or in neighbouring bands; with one part more than the largest
difference of a band, linked sets agree in at least one whole word (pigeonhole). Joining on words gives candidates, which are
verified on the sets of hashes.

Words over no shingle say nothing, nor do, in long sketches, those over a single one; they are not joined on. A linked pair is lost only
if all words it agrees in are such; short sketches are therefore drawn several times with other parts. For a pair with the largest
difference that chance is below 1e-7, and it falls steeply with the difference. Shingles and sets are compared by 64-bit hashes.

Equal sets are one class from the start. Words that many classes share (a group of near copies) don't become all
pairs: in every group a leader, the class that shares most words with others, is compared with the rest. What is then connected needs no
further comparison; members of different components of a leader's cluster are compared in tiles of two bounded blocks,
as matrix products, of which only a spanning forest of the links found comes out. Keys are
counted before they are shuffled, sets are joined by class, so no group is collected anywhere.

Null and empty texts and texts without a word have the empty set: no class, no link, a component of their own. A text with fewer than k words
has its whole sequence as one shingle. Repeated ids are rows of their own with the component of their text; a row with a null id gets null. An
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .columns import free_names
from .components import components
from .pieces import spread
from .storage import stored
from .textbytes import buffers, chunks, mix, shingles, word_hashes, words


def bands(num: int, den: int, most: int) -> np.ndarray:
    """First sizes of the bands up to size `most` and one further."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * den // num)))
    edges.append(-(-edges[-1] * den // num))
    return np.array(edges)


def parts_of(edges: np.ndarray, band: int, num: int, den: int) -> int:
    """One more than the largest difference of linked sets of which the smaller lies in this band."""
    a = int(edges[band + 1]) - 1
    return (a + a * den // num) * (den - num) // (den + num) + 1


def draws(parts: int) -> int:
    return 6 if parts < 16 else 2 if parts < 64 else 1


def sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(different shingle hashes of all rows, sorted within a row; where each row's begin, and their end)."""
    rows = len(offsets) - 1
    start, end, row = words(raw, offsets)
    h, of = shingles(word_hashes(raw, start, end), row, rows, k)
    at = np.searchsorted(of, np.arange(rows + 1))
    for i in np.flatnonzero(np.diff(at) > 1):
        h[at[i] : at[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def set_ids(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as a signed number."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix(flat), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def keys_of(flat: np.ndarray, at: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys under which the sets are joined, as the smaller and as the larger of a pair; set of each key), sets in order."""
    n = np.diff(at)
    edges = bands(num, den, int(n.max(initial=1)))
    parts_by_band = np.array([parts_of(edges, g, num, den) for g in range(len(edges) - 1)])
    draws_by_band = np.array([draws(p) for p in parts_by_band])
    band = np.searchsorted(edges, np.maximum(n, 1), "right") - 1
    row = np.repeat(np.arange(len(n)), n)
    keys, of = [], []
    for scheme in (band, band - 1):
        at_home = scheme == band
        # larger partners of a band's sets reach only so far into the next band; one part means equal sets, one class
        fits = (n > 0) & (scheme >= 0) & (at_home | (n * num <= (edges[band] - 1) * den)) & (parts_by_band[scheme] > 1)
        for draw in range(max(draws_by_band)):
            mine = fits & (draws_by_band[scheme] > draw)
            if not mine.any():
                continue
            parts = np.where(mine, parts_by_band[scheme], 0)
            base = np.cumsum(parts) - parts
            seed = (scheme * 64 + draw).astype(np.uint64)
            own = mine[row]
            r = row[own]
            h = mix(flat[own] + mix(seed)[r])
            place = base[r] + ((h >> np.uint64(32)) * parts[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            word = np.zeros(int(parts.sum()), np.uint64)
            np.bitwise_xor.at(word, place, h)
            over = np.bincount(place, minlength=len(word))
            set_of = np.repeat(np.arange(len(n)), parts)
            use = np.flatnonzero(over >= np.where(parts[set_of] >= 16, 2, 1))
            which = set_of[use]
            part = (use - base[which]).astype(np.uint64)
            keys.append(mix(word[use] + mix(part + (seed[which] << np.uint64(32)))))
            of.append(which)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    all_keys, all_of = np.concatenate(keys), np.concatenate(of)
    order = np.argsort(all_of, kind="stable")
    return all_keys[order], all_of[order]


def signatures(docs: DataFrame, *, k: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Per row: id, n (size of its set), class (null without shingles), keys. A map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            for lo, hi, part, places in chunks(raw, offsets):
                flat, at = sets(part, places, k)
                keys, of = keys_of(flat, at, num, den)
                n = np.diff(at)
                ends = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n), pa.array(set_ids(flat, at), mask=n == 0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))], ["id", "n", "class", "keys"])

    picked = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return picked.mapInArrow(run, "id long, n long, class long, keys array<long>")


def _members(signed: DataFrame) -> DataFrame:
    """(key, class) for every key that two classes or more have. Keys are counted first; a filter of fixed size over those that came
    twice lets the second pass drop nearly all others before the shuffle."""
    keys = signed.where("class is not null").select(F.explode("keys").alias("key"))
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    filled = signed.sparkSession.sparkContext.broadcast(bloom.build(twice, "key"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            keep = bloom.holds(filled.value, flat.to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([flat.filter(pa.array(keep)), batch.column(0).take(pa.array(of[keep]))], ["key", "class"])

    found = signed.where("class is not null").select("class", "keys").mapInArrow(some, "key long, class long")
    found = stored(found.distinct(), "keys")
    groups = found.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(found.join(groups, "key"), "members")


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    first = pairs.join(held.select(F.col("class").alias("a"), F.col("hashes").alias("x"), F.col("n").alias("p")), "a")
    second = first.join(held.select(F.col("class").alias("b"), F.col("hashes").alias("y"), F.col("n").alias("q")), "b")
    fitting = second.where((F.least("p", "q") * den >= F.greatest("p", "q") * num)).select("a", "b", "x", "y")
    return fitting.mapInArrow(run, "a long, b long")


def _held(docs: DataFrame, wanted: DataFrame, *, k: int, key: str, text: str) -> DataFrame:
    """(class, n, hashes) of the wanted classes; wanted: (class, id), id a row that has the set. Rows are dropped in
    the scan by a filter of fixed size over the ids, before anything is shuffled."""
    filled = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select(F.xxhash64("id").alias("h")), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(bloom.holds(filled.value, batch.column(2).to_numpy().view(np.uint64)))
            ids, (raw, offsets) = batch.column(0).filter(keep), buffers(batch.column(1).filter(keep))
            for lo, hi, part, places in chunks(raw, offsets):
                flat, at = sets(part, places, k)
                packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((8 * at).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(set_ids(flat, at)), pa.array(np.diff(at)), packed], ["id", "class", "n", "hashes"])

    picked = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("id"), docs[text].alias("text"), F.xxhash64(docs[key].cast("long")).alias("h"))
    rows = picked.mapInArrow(run, "id long, class long, n long, hashes binary")
    # an id may be there twice with other texts: the class says which sets are meant; one shuffle serves the join and the copies
    needed = rows.select("class", "n", "hashes").join(wanted.select("class"), "class", "left_semi")
    return stored(needed.dropDuplicates(["class"]), "sets")


def _across(open_: DataFrame, held: DataFrame, num: int, den: int, block_bytes: int = 1 << 20) -> DataFrame:
    """Links (a, b) between different components of a cluster. open_: (cluster, class, component). A cluster's sets are dealt to
    blocks of about block_bytes; every two blocks meet in one task, which counts what their sets share by matrix products
    and returns a spanning forest of the links it finds. No pair becomes a row unless it is in that forest."""
    rows = open_.join(held, "class")
    blocks = rows.groupBy("cluster").agg(F.ceil(F.sum(8 * F.col("n")) / block_bytes).cast("long").alias("blocks"))
    dealt = rows.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    # each block goes to all tiles (i <= j) that it is a side of
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "class", "component", "n", "hashes")

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cls, comp, n = (table.column(c).to_numpy() for c in ("class", "component", "n"))
        flat = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("hashes")])
        of = np.repeat(np.arange(len(n)), n)
        code, known = pd.factorize(flat)
        often = np.bincount(code)
        shared = np.flatnonzero(often > 1)
        both = np.zeros((len(n), len(n)), np.float32)
        order = np.argsort(code, kind="stable")
        begin = np.cumsum(often) - often
        for lo in range(0, len(shared), 2048):
            some = shared[lo : lo + 2048]
            places, ends = spread(often, begin, some)
            m = np.zeros((len(n), len(some)), np.float32)
            m[of[order[places]], np.repeat(np.arange(len(some)), np.diff(ends))] = 1
            both += m @ m.T
        union = n[:, None] + n[None, :] - both
        x, y = np.nonzero((den * both >= num * union) & (comp[:, None] < comp[None, :]))
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = v = parent.get(up, up)
            return v

        a, b = [], []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            r, t = root(int(comp[p])), root(int(comp[q]))
            if r != t:
                parent[r] = t
                a.append(min(cls[p], cls[q]))
                b.append(max(cls[p], cls[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("cluster", "i", "j").applyInArrow(tile, "a long, b long")


def classes(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n (size of its set) and component, the smallest id that links lead to."""
    signed = stored(signatures(docs, k=k, num=num, den=den, key=key, text=text), "signatures")
    members = _members(signed)
    ids = signed.where("id is not null and class is not null").groupBy("class").agg(F.min("id").alias("id"))
    seen = stored(members.groupBy("class").agg(F.sum("size").alias("shared")).join(ids, "class", "left"), "shared")
    held = _held(docs, seen.where("id is not null").select("class", "id"), k=k, key=key, text=text)

    placed = members.join(seen.select("class", "shared"), "class")
    leaders = placed.groupBy("key").agg(F.max(F.struct("shared", "class"))["class"].alias("leader"))
    led = stored(members.join(leaders, "key").select(F.col("leader").alias("cluster"), "class").distinct(), "clusters")
    pairs = led.select(F.least("cluster", "class").alias("a"), F.greatest("cluster", "class").alias("b")).where("a < b").distinct()
    links = stored(_verified(pairs, held, num, den), "links")
    joined = stored(components(links), "joined")

    # what a leader doesn't connect: classes of one cluster in different components
    now = led.join(joined.withColumnRenamed("id", "class"), "class", "left").select("cluster", "class", F.coalesce("component", "class").alias("component"))
    mixed = now.groupBy("cluster").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi and size > 2").select("cluster")
    # the leader itself has been compared with all
    open_ = stored(now.join(mixed, "cluster").where("class <> cluster"), "open")
    more = stored(_across(open_, held, num, den), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    named = signed.select("id", "n", "class").join(joined.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = stored(named, "named")
    least = named.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = named.join(least, "component", "left")
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component"))


def one_of_each(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of every component the one with the smallest id; columns unchanged. Rows with a null
    id stay, and of rows with one and the same id and linked texts all do."""
    found = classes(docs, k=k, num=num, den=den, key=key, text=text)
    (lost,) = free_names(docs, "__gone")
    gone = found.where("id <> component").select(F.col("id").alias(lost)).distinct()
    return docs.join(gone, docs[key].cast("long") == F.col(lost), "left_anti")
