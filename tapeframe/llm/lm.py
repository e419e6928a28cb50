"""Language-model scores from a log-frequency Bloom filter.

The filter holds the counts of all words and bigrams of the training texts in quantised form: an n-gram with level q (two levels per
doubling) is entered once per level 0..q, under keys made of its hash and the level, so a count is read by probing level after level
until one is missing. It is cut by ranges of the n-gram's hash. Each range's filter is as large as its exact level totals need for the
share `fill` of set bits, so it grows with the corpus and errs as often at any size; the number of ranges grows too, which bounds one.
Nothing of it is broadcast: the different n-grams of every chunk of texts go to their ranges, and their levels come back to the chunk. Words
of the head (see below) are not asked: their level is that of the exact count.

Tokens are words (A-Z as a-z) and one end per text. The model mixes a bigram and a unigram estimate,
p = w c(v,t)/c(v) + (1-w) (c(t)+1)/(N+V+1), counts as the filter gives them; w is chosen from a grid by the likelihood of all
training texts, each text's own counts taken off. The base score beside it uses exact counts c(t): those of the `head` most
frequent words go to every task (a bounded table), those of all other words are joined by hash.

Null texts are empty; an empty text has its end only. Nothing to train on gives N = V = 0 and the uniform estimate. Equal texts get
equal scores; repeated and null ids are rows of their own. Words are compared by 64-bit hashes, bigrams by 48 bits of one. An empty table gives no
rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from . import bloom
from .storage import folder_uri, read_file, stored, write_file
from .textbytes import buffers, chunks, mix, word_hashes, words

END = np.uint64(0x5851F42D4C957F2D)  # the hash of the end token
START = np.uint64(0x14057B7EF767814F)  # of the context that begins a text
CHUNK = 4 << 20
LEVELS = 100
WEIGHTS = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
UNI, BI = 0, 1


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all tokens, each row's end included."""
    start, end, row = words(raw, offsets)
    rows = len(offsets) - 1
    h = np.concatenate([word_hashes(raw, start, end), np.full(rows, END)])
    of = np.concatenate([row, np.arange(rows)])
    order = np.argsort(of, kind="stable")  # a row's end comes behind its words
    return h[order], of[order]


def contexts(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.concatenate([[True], row[1:] != row[:-1]])[: len(h)]] = START
    return before


def bigrams(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + h) & ~np.uint64(0xFFFF)


def level(n: np.ndarray) -> np.ndarray:
    """Two levels per doubling: 1 is level 0, 2 level 2, 3 level 3, 4 and 5 level 4, 6 and 7 level 5."""
    n = np.maximum(n, 1).astype(np.float64)
    return np.minimum(np.floor(2 * np.log2(n) + 1e-9).astype(np.int64), LEVELS - 1)


_EDGES = np.ceil(2.0 ** (np.arange(LEVELS + 1) / 2) - 1e-9)
# what a level stands for: the mean of the counts in it, 0 for none
_COUNTS = np.concatenate([[0.0], np.maximum((_EDGES[:-1] + _EDGES[1:] - 1) / 2, _EDGES[:-1])])


def level_keys(h: np.ndarray, j: int) -> np.ndarray:
    return mix(h + np.uint64((j + 1) * 0xD6E8FEB86659FD93 % (1 << 64)))


def probed(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The level of each n-gram in the filter, -1 for none."""
    out = np.full(len(h), -1)
    live = np.arange(len(h))
    for j in range(LEVELS):
        live = live[bloom.holds(filled, level_keys(h[live], j))]
        if not len(live):
            break
        out[live] = j
    return out


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, and counts; compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps).tobytes() + counts.astype("<u4").tobytes())


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=12 * n)
    steps = np.ascontiguousarray(np.frombuffer(raw[: 8 * n], np.uint8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw[8 * n :], "<u4").astype(np.int64)


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def filled_by(h: np.ndarray, n: np.ndarray, fill: float) -> np.ndarray:
    """The filter of n-grams and their counts, of the size at which a share `fill` of its bits is set."""
    top = level(n)
    unit = 8 * bloom.SEGMENTS
    bits = unit * max(1, math.ceil(bloom.PROBES * int((top + 1).sum()) / -math.log(1 - fill) / unit))
    out = np.zeros(bits, bool)
    for j in range(int(top.max(initial=-1)) + 1):
        keys = level_keys(h[top >= j], j)
        for probe in range(bloom.PROBES):
            out[bloom.places(keys, bits, probe)] = True
    return np.packbits(out)


def range_bits(docs: DataFrame, *, text: str = "text", bits: int = 1 << 28, range_tokens: int = 2_000_000) -> int:
    """How many leading bits of an n-gram's hash name its range: so many that a range's filter stays under `bits`."""
    chars = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    return max(6, math.ceil(math.log2(max(1, chars / 6 / min(range_tokens, bits // 32)))))


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranges that sorted keys lie in, where each range's begin)."""
    ends = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    return np.flatnonzero(np.diff(ends)), ends


def count_ngrams(docs: DataFrame, training: Column, bits: int, *, text: str = "text", fill: float = 0.2) -> DataFrame:
    """Over all training texts: (kind, bucket, filled), the filter of each range of words and of bigrams, and (h, n), the exact count of
    every word. Counts are summed within a chunk, then by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for _, _, part, at in chunks(raw, offsets, CHUNK):
                h, row = tokens(part, at)
                for kind, keys in ((UNI, h), (BI, bigrams(contexts(h, row), h))):
                    keys, n = np.unique(keys, return_counts=True)
                    some, ends = _cut(keys, bits)
                    data = [_packed(keys[ends[b] : ends[b + 1]], n[ends[b] : ends[b + 1]]) for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(some), pa.int32()), pa.array(some), pa.array(np.diff(ends)[some]), pa.array(data, pa.binary())], ["kind", "bucket", "size", "data"])

    def merge(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        parts = [_unpacked(d, s) for d, s in zip(table.column("data").to_pylist(), table.column("size").to_pylist(), strict=True)]
        keys, n = _totals(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        filled = pa.array([filled_by(keys, n, fill).tobytes()], pa.binary())
        if kind == BI:
            keys, n = keys[:0], n[:0]
        m = len(keys)
        h, n = (pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x.astype(np.int64))]) for x in (keys.view(np.int64), n))
        return pa.table({"kind": pa.array([kind] * (m + 1), pa.int32()), "bucket": pa.array([bucket] * (m + 1), pa.int64()), "filled": pa.concat_arrays([filled, pa.nulls(m, pa.binary())]), "h": h, "n": n})

    parts = docs.where(training).select(docs[text].alias("text")).mapInArrow(run, "kind int, bucket long, size long, data binary")
    return stored(parts.groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket long, filled binary, h long, n long"), "ngrams")


@dataclass(frozen=True)
class Model:
    filters: DataFrame  # kind, bucket, filled
    bits: int  # of a hash that name its range
    total: int  # N
    distinct: int  # V
    weight: float
    head: np.ndarray  # hashes of the most frequent words, sorted
    head_counts: np.ndarray


def _estimates(c: np.ndarray, before: np.ndarray, both: np.ndarray, total: np.ndarray | int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """(bigram, unigram) estimates per token from the counts of it, of the token before it, and of both."""
    context = np.maximum(before, both)
    return np.divide(both, context, out=np.zeros(len(c)), where=context > 0), (c + 1) / (total + distinct + 1)


def _rest(q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What is left of a count of level q without a text's own: nothing if the text's own is of that level already."""
    return np.where(level(own) >= q, 0, np.maximum(_COUNTS[q + 1] - own, 0))


def _own(row: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How often each token's n-gram comes in the token's row."""
    _, at, n = np.unique(row * (int(of.max(initial=0)) + 1) + of, return_inverse=True, return_counts=True)
    return n[at]


def _fit(docs: DataFrame, training: Column, *, text: str, bits: int, fill: float, head: int) -> tuple[Model, DataFrame]:
    """A model that has no weight yet, and the exact word counts (h, n)."""
    by = range_bits(docs, text=text, bits=bits)
    grams = count_ngrams(docs, training, by, text=text, fill=fill)
    counts = grams.where("h is not null").select("h", "n")
    all_ = counts.agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    q = F.floor(2 * F.log2("n") + 1e-9)
    room, least = head, math.inf
    for r in counts.groupBy(q.alias("q")).agg(F.count("*").alias("m")).orderBy(F.desc("q")).collect():  # LEVELS rows at most
        room -= r["m"]
        if room < 0:
            break
        least = r["q"]
    most = sorted((r["h"], r["n"]) for r in counts.where(q >= F.lit(float(least))).collect())
    h = np.array([x for x, _ in most], np.int64).view(np.uint64)
    order = np.argsort(h)
    filters = grams.where("filled is not null").select("kind", "bucket", "filled")
    return Model(filters, by, all_["total"] or 0, all_["distinct"], 0.0, h[order], np.array([n for _, n in most], np.int64)[order]), counts


def _measured(docs: DataFrame, model: Model, weights: tuple[float, ...], training: Column, *, text: str, keep: list[str]) -> DataFrame:
    """Per row: the columns in `keep`, row, n_tokens, known, base (over the most frequent words), scores (by weight), rare and times (all
    other words), and fits: by weight of the grid, the likelihood of a training text without its own counts, else null."""
    spark = docs.sparkSession
    by = model.bits
    carried = [*keep, "__training"]
    picked = docs.select(*[docs[c] for c in keep], training.alias("__training"), docs[text].alias("__text"))

    folder = folder_uri(spark, "texts")

    def keep_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        for batch in batches:
            raw, offsets = buffers(batch.column(len(carried)))
            for lo, hi, part, at in chunks(raw, offsets, CHUNK):
                h, row = tokens(part, at)
                u, of = np.unique(h, return_inverse=True)
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([batch.column(i)[lo:hi] for i in range(len(carried))], carried)
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                planes = np.ascontiguousarray(of.astype("<u4").view(np.uint8).reshape(-1, 4).T)
                flat = np.array([len(u), len(h)], "<i8").tobytes() + u.astype("<u8").tobytes() + planes.tobytes() + np.bincount(row, minlength=hi - lo).astype("<i8").tobytes()
                uri = write_file(folder, "tokens", zstandard.ZstdCompressor(level=1).compress(flat))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([uri]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "uri", "rows"])
                chunk += 1

    def kept_tokens(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(different words, place of each token among them, number of tokens by row)."""
        raw = zstandard.ZstdDecompressor().decompress(read_file(uri))
        n_words, n_tokens = np.frombuffer(raw, "<i8", 2).tolist()
        u = np.frombuffer(raw, "<u8", n_words, 16)
        of = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n_tokens, 16 + 8 * n_words).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        return u, of, np.frombuffer(raw, "<i8", -1, 16 + 8 * n_words + 4 * n_tokens)

    shared = spark.sparkContext.broadcast((model.head, model.head_counts))

    def in_head(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the head, whether it is there) of words."""
        head = shared.value[0]
        place = np.minimum(np.searchsorted(head, u), max(0, len(head) - 1))
        return place, head[place] == u if len(head) else np.zeros(len(u), bool)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, of, lengths = kept_tokens(uri)
                h = u[of]
                for kind, keys in ((UNI, u[~in_head(u)[1]]), (BI, np.unique(bigrams(contexts(h, np.repeat(np.arange(len(lengths)), lengths)), h)))):
                    some, ends = _cut(keys, by)
                    data = [_packed(k := keys[ends[b] : ends[b + 1]], np.zeros(len(k))) for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), pa.array(some), pa.array(np.diff(ends)[some]), pa.array(data, pa.binary())], ["chunk", "kind", "bucket", "size", "data"])

    def answer(asked: pa.Table, filters: pa.Table) -> pa.Table:
        sizes = asked.column("size").to_pylist()
        keys = [_unpacked(d, s)[0] for d, s in zip(asked.column("data").to_pylist(), sizes, strict=True)]
        found = np.full(sum(sizes), -1, np.int8)
        if len(filters) and keys:
            found = probed(np.frombuffer(filters.column("filled")[0].as_py(), np.uint8), np.concatenate(keys)).astype(np.int8)
        levels = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(found, np.cumsum(sizes)[:-1])] if keys else []
        return pa.table({"chunk": asked.column("chunk"), "kind": asked.column("kind"), "bucket": asked.column("bucket"), "levels": pa.array(levels, pa.binary())})

    total, distinct = model.total, model.distinct
    names = ["row", "n_tokens", "known", "base", "scores", "fits", "rare", "times"]

    def measure(text: pa.Table, answers: pa.Table) -> pa.Table:
        u, of, lengths = kept_tokens(text.column("uri")[0].as_py())
        n, h = len(lengths), u[of]
        row = np.repeat(np.arange(n), lengths)
        _, pair = np.unique(bigrams(contexts(h, row), h), return_inverse=True)
        answers = answers.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kinds = answers.column("kind").to_pylist()
        levels = [zstandard.ZstdDecompressor().decompress(x) for x in answers.column("levels").to_pylist()]
        q, q_pair = (np.frombuffer(b"".join(x for x, k in zip(levels, kinds, strict=True) if k == kind), np.int8).astype(np.int64) for kind in (UNI, BI))
        # words of the head have the level of their exact count, without asking
        place, common = in_head(u)
        answered, q = q, np.full(len(u), -1)
        q[~common] = answered
        if common.any():
            q[common] = level(shared.value[1][place[common]])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]

        def sums(c: np.ndarray, both: np.ndarray, ws: tuple[float, ...], own: np.ndarray | int = 0) -> pa.Array:
            before = np.concatenate([[0], c[:-1]])
            before[starts] = 0  # the context that begins a text isn't counted
            pairs, one = _estimates(c, before, both, total - own, distinct)
            by_weight = np.zeros((n, 0)) if not ws else np.stack([np.bincount(row, np.log10(np.maximum(w * pairs + (1 - w) * one, 1e-300)), n) for w in ws], 1)
            return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * len(ws)).astype(np.int32)), pa.array(by_weight.ravel()))

        c, both = _COUNTS[q + 1][of], _COUNTS[q_pair + 1][pair]
        scores = sums(c, both, weights)
        rows = pa.ipc.open_stream(text.column("rows")[0].as_py()).read_all().combine_chunks()
        trained = rows.column("__training").combine_chunks().fill_null(False)
        fits = pa.nulls(n, pa.list_(pa.float64()))
        if pa.compute.any(trained).as_py():
            fits = pa.compute.if_else(trained, sums(_rest(q[of], _own(row, of)), _rest(q_pair[pair], _own(row, pair)), WEIGHTS, lengths[row]), pa.scalar(None, pa.list_(pa.float64())))

        head_counts = shared.value[1]
        scale = math.log10(total + distinct + 1)
        place, common = place[of], common[of]
        base = np.bincount(row[common], np.log10(head_counts[place[common]] + 1) - scale, n).astype(np.float64)
        known = np.bincount(row[common], minlength=n)
        # every other word of a row once, with how often it comes
        order = np.lexsort((h[~common], row[~common]))
        r, w = row[~common][order], h[~common][order]
        new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])[: len(w)])
        times = np.diff(np.append(new, len(w)))
        ends = pa.array(np.searchsorted(r[new], np.arange(n + 1)).astype(np.int32))
        ids = (text.column("chunk")[0].as_py() << 22) + np.arange(n)
        columns = [pa.array(ids), pa.array(lengths), pa.array(known), pa.array(base), scores, fits, pa.ListArray.from_arrays(ends, pa.array(w[new].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))]
        return pa.table([*[rows.column(x) for x in keep], *columns], [*keep, *names])

    # the tokens are in files; small rows are dealt by number, not by size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = stored(picked.mapInArrow(keep_tokens, "chunk long, uri string, rows binary"), "texts")
    asked = texts.select("chunk", "uri").repartition(parts, "chunk").mapInArrow(ask, "chunk long, kind int, bucket long, size long, data binary")
    answers = asked.groupBy("kind", "bucket").cogroup(model.filters.groupBy("kind", "bucket")).applyInArrow(answer, "chunk long, kind int, bucket long, levels binary")
    own = T.StructType.fromDDL("row long, n_tokens long, known long, base double, scores array<double>, fits array<double>, rare array<long>, times array<int>")
    schema = T.StructType([*picked.select(*keep).schema, *own])
    by_chunk = texts.repartition(parts, "chunk").groupBy("chunk").cogroup(answers.repartition(parts, "chunk").groupBy("chunk"))
    return stored(by_chunk.applyInArrow(measure, schema), "scored")


def _weight(measured: DataFrame, model: Model) -> int:
    """The place in WEIGHTS of the weight that fits all training texts best, the smallest of equal ones."""
    best = measured.where("fits is not null").select(F.posexplode("fits").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy(F.desc("s"), "i").first()
    return best["i"] if best and model.total else 0


def train(docs: DataFrame, training: Column, *, text: str = "text", bits: int = 1 << 28, fill: float = 0.2, head: int = 1 << 17) -> tuple[Model, DataFrame]:
    """The model and the exact word counts (h, n). `bits` bounds the filter of one range of n-grams."""
    model, counts = _fit(docs, training, text=text, bits=bits, fill=fill, head=head)
    measured = _measured(docs.where(training), model, (), F.lit(True), text=text, keep=[])
    return replace(model, weight=WEIGHTS[_weight(measured, model)]), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns in `keep` (the key by default), n_tokens, n_known, train_tokens, base_score, score."""
    keep = keep or [key]
    return _finished(_measured(docs, model, (model.weight,), F.lit(False), text=text, keep=keep), model, counts, 0, keep)


def train_and_score(docs: DataFrame, training: Column, *, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, bits: int = 1 << 28, fill: float = 0.2, head: int = 1 << 17) -> DataFrame:
    """score() of the texts that contain those the model is of, which are looked up once for both."""
    keep = keep or [key]
    model, counts = _fit(docs, training, text=text, bits=bits, fill=fill, head=head)
    measured = _measured(docs, model, WEIGHTS, training, text=text, keep=keep)
    return _finished(measured, model, counts, _weight(measured, model), keep)


def _finished(rows: DataFrame, model: Model, counts: DataFrame, at: int, keep: list[str]) -> DataFrame:
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    scale = math.log10(model.total + model.distinct + 1)
    found = rare.join(counts, "h", "left").groupBy("row").agg(F.sum(F.col("times") * (F.log10(c + 1) - scale)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = rows.drop("rare", "times", "fits").join(found, "row", "left")
    none = F.lit(0)
    return out.select(*keep, "n_tokens", (F.col("known") + F.coalesce("more_known", none)).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.col("scores")[at].alias("score"))
