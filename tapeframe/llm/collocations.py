"""Phrases whose words come together more often than apart, mined from stripes.

A stripe is a prefix of words with the counter of the words that follow it inside a piece of text, the end of the piece being one of
them. Tasks count the stripes of a chunk; equal prefixes are merged elementwise. One merged structure has all that is
needed: its entries are the counts of the extended phrases, its total is the count of the prefix, and its greatest entry says whether
a longer phrase stands for the prefix. Stripes of longer prefixes are taken only where the prefix and what would follow its first word
are frequent themselves (a longer phrase can't be more frequent); a Bloom filter of the frequent phrases says where. It is sized by
their number up to `filter_bits`, beyond which it lets more through and changes no result.

Stripes are dealt to buckets by their prefix, as many as keep a bucket near `bucket_tokens` words. A prefix with more than one word
in 2048 of the corpus (the list of these is bounded by that share) has its stripe cut by the following word over all buckets; when there
are more than 2048 buckets, all stripes are cut by the following word into that many times more segments. Totals are sums over segments.

Everything is per language (null: `und`). Words are compared by 64-bit hashes and looked up for the phrases that are reported.
Null and empty texts have no words. Repeated rows count each. Ids and other columns are not looked at. Ties in score and count go to
the phrase that sorts first by bytes. An empty table gives no rows. Scores are exact, in 38-digit decimals.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .storage import stored
from .terms import hashed, separators
from .textbytes import LOWER, buffers, chunks, mix

CUT = separators(outside=b" \t.,;:!?\n\x0b\x0c\r")
BREAK = separators(outside=b".,;:!?\n\x0b\x0c\r")
CHUNK = 4 << 20
END = np.uint64(0x3C6EF372FE94F82B)  # follows the last word of a piece
SHARES = 4096  # a prefix is heavy that has one word in so many; each chunk names its own
UND = "und"


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(language, hashes of its words in a chunk, whether the next word follows in the same piece, bytes, starts, ends)."""
    for batch in batches:
        raw, offsets = buffers(batch.column(0))
        languages = batch.column(1).dictionary_encode()
        of_row = languages.indices.to_numpy()
        for lo, hi, part, at in chunks(raw, offsets, CHUNK):
            h, start, end, row = hashed(part, at, CUT)
            if not len(h):
                continue
            breaks = np.concatenate([[0], np.cumsum(BREAK[part], dtype=np.int32)])
            joined = np.append((row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1]]), False)
            code = of_row[lo:hi][row]
            for c in np.unique(code).tolist():
                mine = slice(None) if (code == c).all() else np.flatnonzero(code == c)
                yield languages.dictionary[c].as_py(), h[mine], joined[mine], part, start[mine], end[mine]


def _keys(language: str, grams: np.ndarray) -> np.ndarray:
    """A hash per phrase (columns are its words) of a language."""
    out = np.full(len(grams), np.frombuffer(hashlib.blake2b(language.encode(), digest_size=8).digest(), "<u8")[0], np.uint64)
    for j in range(grams.shape[1]):
        out = mix(out * np.uint64(3) + grams[:, j])
    return out


def survey(texts: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """((lang, n) words by language, all words, heavy words: lang, words, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, h, *_ in _by_language(batches):
            words, n = np.unique(h, return_counts=True)
            often = n * SHARES >= len(h)
            words, n = words[often].view(np.int64), n[often]
            yield pa.RecordBatch.from_arrays([pa.array([language] * (len(n) + 1), pa.string()), pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(words)]), pa.concat_arrays([pa.array([len(h)], pa.int64()), pa.array(n, pa.int64())])], ["lang", "word", "n"])

    found = stored(texts.mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "survey")
    totals = found.where("word is null").select("lang", "n")
    total = totals.agg(F.sum("n")).first()[0] or 0
    return totals, total, found.where(F.col("word").isNotNull() & (F.col("n") * SHARES >= total)).select("lang", F.array("word").alias("words"), "n")


def _packed(prefix: np.ndarray, following: np.ndarray, n: np.ndarray) -> bytes:
    """Stripes: prefixes, sizes, following words, counts; numbers as byte planes, compressed."""
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(1)])[: len(prefix)])
    sizes = np.diff(np.append(new, len(prefix)))
    planes = [np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(len(x.ravel()), -1).T).tobytes() for x, t in ((prefix[new].ravel(), "<u8"), (sizes, "<u4"), (following, "<u8"), (n, "<u4"))]
    return np.array([len(new), len(n)], "<i8").tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stripes, entries = np.frombuffer(data, "<i8", 2).tolist()
    raw, at, out = zstandard.ZstdDecompressor().decompressobj().decompress(data[16:]), 0, []
    for size, t in ((stripes * width, "<u8"), (stripes, "<u4"), (entries, "<u8"), (entries, "<u4")):
        bytes_ = size * int(t[2])
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, bytes_, at).reshape(int(t[2]), size).T).view(t).ravel())
        at += bytes_
    prefixes, sizes, following, n = out
    return np.repeat(prefixes.reshape(stripes, width), sizes, axis=0), following, n.astype(np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal prefixes' counters added up, sorted by prefix and following word."""
    prefix, following, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((following, *prefix.T[::-1]))
    prefix, following, n = prefix[order], following[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(1) | (following[1:] != following[:-1])])[: len(n)])
    return prefix[new], following[new], np.add.reduceat(n, new) if len(new) else n


def stripes(texts: DataFrame, width: int, least: int, heavy: DataFrame, total: int, known: np.ndarray | None, *, bucket_tokens: int) -> DataFrame:
    """(lang, words, n, whole): the frequent extensions of prefixes of `width` words, and with `whole` the total of each prefix in
    one of its segments. `known`: a filter of the frequent phrases of `width` words, where width > 1."""
    bits = max(4, math.ceil(math.log2(max(1, total / bucket_tokens))))
    cut_bits = max(0, bits - 11)
    wide = {(r["lang"], tuple(r["words"])) for r in heavy.collect()}  # at most SHARES of them
    spread: dict[str, np.ndarray] = {}
    for language in {x for x, _ in wide}:
        spread[language] = np.sort(_keys(language, np.array([w for x, w in wide if x == language], np.int64).view(np.uint64).reshape(-1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, h, joined, *_ in _by_language(batches):
            following = np.append(h[1:], END)
            if width == 1:
                grams, following = h[:, None], np.where(joined, following, END)
                keys = _keys(language, grams)
            else:
                inside = joined[: max(0, len(h) - width + 1)].copy()  # do width words follow each other
                for j in range(1, width - 1):
                    inside &= joined[j : len(inside) + j]
                at = np.flatnonzero(inside)
                grams = np.stack([h[at + j] for j in range(width)], 1) if len(at) else np.zeros((0, width), np.uint64)
                keys = _keys(language, grams)
                frequent = np.zeros(len(h) + 1, bool)
                frequent[at[bloom.holds(known, keys)]] = True
                # both this phrase and the one that begins a word later
                some = frequent[at] & frequent[at + 1] & joined[at + width - 1]
                grams, keys, following = grams[some], keys[some], h[np.minimum(at[some] + width, len(h) - 1)]
            salt = (following >> np.uint64(64 - cut_bits)) if cut_bits else np.zeros(len(following), np.uint64)
            if language in spread:
                place = np.minimum(np.searchsorted(spread[language], keys), len(spread[language]) - 1)
                salt = np.where(spread[language][place] == keys, following, salt)
            order_key = (mix(keys + salt) & ~np.uint64(0xFFFFFF)) | (mix(following) >> np.uint64(40))
            order = np.argsort(order_key)
            order_key, grams, following = order_key[order], grams[order], following[order]
            new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]).any(1) | (following[1:] != following[:-1])])[: len(order)])
            n = np.diff(np.append(new, len(order)))
            grams, following = grams[new], following[new]
            ends = np.append(np.searchsorted(order_key[new], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(new))
            some = np.flatnonzero(np.diff(ends))
            data = [_packed(grams[a:b], following[a:b], n[a:b]) for a, b in zip(ends[some].tolist(), ends[some + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(data, pa.binary())], ["lang", "bucket", "data"])

    def merge(table: pa.Table) -> pa.Table:
        prefix, following, n = merged([_unpacked(d, width) for d in table.column("data").to_pylist()])
        often = (n >= least) & (following != END)
        phrases = np.concatenate([prefix[often], following[often][:, None]], 1)
        counts, lists = n[often], [pa.ListArray.from_arrays(pa.array(np.arange(len(phrases) + 1) * (width + 1), pa.int32()), pa.array(phrases.ravel().view(np.int64)))]
        whole = np.zeros(len(counts), bool)
        if width == 1:
            first = np.flatnonzero(np.concatenate([[True], prefix[1:, 0] != prefix[:-1, 0]])[: len(prefix)])
            totals = np.add.reduceat(n, first)
            language = table.column("lang")[0].as_py()
            keep = totals >= least
            if cut_bits:
                keep[:] = True
            elif language in spread:  # a heavy prefix has a part of its total in every bucket
                keep |= np.isin(_keys(language, prefix[first]), spread[language])
            counts, whole = np.append(counts, totals[keep]), np.append(whole, np.ones(int(keep.sum()), bool))
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(int(keep.sum()) + 1), pa.int32()), pa.array(prefix[first][keep].ravel().view(np.int64))))
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(counts), pa.string()), "words": pa.concat_arrays(lists), "n": pa.array(counts, pa.int64()), "whole": pa.array(whole)})

    parts = texts.mapInArrow(run, "lang string, bucket long, data binary")
    return stored(parts.groupBy("lang", "bucket").applyInArrow(merge, "lang string, words array<long>, n long, whole boolean"), "stripes")


def _filter(phrases: DataFrame, filter_bits: int) -> np.ndarray:
    """A Bloom filter over phrases (lang, words) of one length, twelve bits each as long as filter_bits allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                languages = batch.column(0).dictionary_encode()
                code = languages.indices.to_numpy()
                words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(len(batch), -1)  # all of one length
                for c, language in enumerate(languages.dictionary.to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(language, words[code == c]).view(np.int64))], ["k"])

    bits = min(filter_bits, 1 << max(16, math.ceil(math.log2(12 * max(1, phrases.count())))))
    return bloom.build(phrases.select("lang", "words").mapInArrow(run, "k long"), "k", bits=bits)


def _spelled(texts: DataFrame, words: DataFrame, filter_bits: int) -> DataFrame:
    """(lang, word, spelling) of wanted words (lang, word), from the texts."""
    wanted = _filter(words.select("lang", F.array("word").alias("words")), filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for language, h, _, part, start, end in _by_language(batches):
            _, first = np.unique(h, return_index=True)
            first = first[bloom.holds(wanted, _keys(language, h[first][:, None]))]
            spellings = [LOWER[part[a:b]].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(first), pa.string()), pa.array(h[first].view(np.int64)), pa.array(spellings, pa.string())], ["lang", "word", "spelling"])

    found = texts.mapInArrow(run, "lang string, word long, spelling string").groupBy("lang", "word").agg(F.min("spelling").alias("spelling"))
    return found.join(words, ["lang", "word"])


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """phrases (lang, words, a) with l, r, score: the least score of all cuts in two, the earliest cut among equal ones.
    counts (lang, words, n) has every part of a phrase."""
    size = F.size("words")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        part = counts.select("lang", F.col("words").alias(side), F.col("n").alias(name))
        cuts = cuts.join(part, ["lang", side])
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"(1000000 * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "words", "a").agg(best).select("lang", "words", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, subsumed_percent: int = 50, top: int = 2000, bucket_tokens: int = 2_000_000, filter_bits: int = 1 << 28) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score. A phrase within a longer one that has
    at least subsumed_percent of its occurrences is left out."""
    texts = docs.select(docs[text].alias("text"), F.coalesce(docs[lang], F.lit(UND)).alias("lang"))
    totals, total, heavy = survey(texts)
    found, known = [], None
    counts = []
    for width in range(1, longest):
        level = stripes(texts, width, least, heavy, total, known, bucket_tokens=bucket_tokens)
        if width == 1:
            counts.append(level.where("whole").groupBy("lang", "words").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        found.append(level.where("not whole").select("lang", "words", "n"))
        counts.append(found[-1])
        if width + 1 < longest:
            heavy = found[-1].where(F.col("n") * SHARES >= total)
            known = _filter(found[-1], filter_bits)
    phrases = reduce(DataFrame.unionByName, found).withColumnRenamed("n", "a")
    # of longer phrases with a phrase inside, the most frequent is always one word longer
    longer = phrases.where(F.size("words") > 2)
    ends = F.explode(F.array(F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1)))
    inside = longer.select("lang", ends.alias("words"), F.col("a").alias("outer")).groupBy("lang", "words").agg(F.max("outer").alias("outer"))
    left = phrases.join(inside, ["lang", "words"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < subsumed_percent * F.col("a"))).drop("outer")
    all_scored = scored(left, reduce(DataFrame.unionByName, counts))
    # a language's phrases are cut in parts of it first, so that its last ranking sees at most about `top` rows a part
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = stored(all_scored.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts))), "scored")
    for keys in (["lang", "part"], ["lang"]):
        place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"))
        near = near.withColumn("place", F.rank().over(place)).where(F.col("place") <= top).drop("place")
    near = stored(near.drop("part"), "phrases")
    spread = near.select("lang", "words", F.posexplode("words").alias("i", "word"))
    spelled = _spelled(texts, stored(spread.select("lang", "word").distinct(), "words"), filter_bits)
    named = spread.join(spelled, ["lang", "word"]).groupBy("lang", "words").agg(F.sort_array(F.collect_list(F.struct("i", "spelling"))).alias("s"))
    named = named.select("lang", "words", F.array_join("s.spelling", " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.join(named, ["lang", "words"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
