"""Language identification by the nearest of several centroids per language.

A text is the vector of its byte n-grams (one to three bytes, A-Z as a-z, digits and signs as one space), hashed to a fixed number of
places, with sublinear counts times inverse document frequencies, normalised. Spherical k-means splits the
sample of each language into clusters, whose centroids stand for it; the prediction is the language of the centroid with the largest cosine.
The distance rejects: a text whose cosine is below the least that its cluster's language has in the sample,
less a margin, is not accepted as any language.

Only text is an input of a prediction. The model is fitted on a bounded sample of labelled rows, sample_rows per
language, chosen by the hash of the row's id; everything else runs over all rows and whole texts. Null texts and
texts without a letter are `und` with score 0 and not accepted. Equal texts get equal predictions; ties go to the language that sorts
first. Without any labelled row every prediction is `und`. An empty table gives no rows. Rows with null ids are predicted like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import buffers, chunks

PLACES = 1 << 13
UND = "und"
LETTER = r"\p{L}"

# Bytes as features see them: lower case, one value for white space, digits and ASCII signs.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[:128] = 32
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray  # by place
    centroids: np.ndarray  # rows are normalised
    of: np.ndarray  # language number of each centroid
    floor: np.ndarray  # by language: least cosine to accept


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each place occurs in each row (rows x PLACES)."""
    rows = len(offsets) - 1
    out = np.zeros((rows, PLACES), np.float32)
    seen = _SEEN[raw]
    step = 256
    for lo in range(0, rows, step):  # bounds the counting table
        hi = min(rows, lo + step)
        part = seen[offsets[lo] : offsets[hi]]
        if not len(part):
            continue
        row = np.repeat(np.arange(hi - lo, dtype=np.int64) * PLACES, np.diff(offsets[lo : hi + 1]))
        gram = part.copy()
        total = np.zeros((hi - lo) * PLACES, np.int64)
        for k in (1, 2, 3):
            if k > 1:
                gram = gram[:-1] * np.uint32(0x01000193) ^ part[k - 1 :]
            whole = row[k - 1 :] == row[: len(row) - k + 1]
            place = (((gram + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
            total += np.bincount((place + row[: len(row) - k + 1])[whole], minlength=len(total))
        out[lo:hi] = total.reshape(hi - lo, PLACES)
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(found) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def fit(texts_counts: np.ndarray, labels: list[str], *, clusters: int = 4, rounds: int = 10, margin: float = 0.5, seed: int = 7) -> Model:
    """Fits centroids to the sample's counts; margin: share of the least in-sample cosine that is still accepted."""
    languages = sorted(set(labels))
    number = np.array([languages.index(x) for x in labels])
    idf = np.log((1 + len(labels)) / (1 + (texts_counts > 0).sum(0))).astype(np.float32) + 1
    v = vectors(texts_counts, idf)
    rng = np.random.default_rng(seed)
    centroids, of = [], []
    for i in range(len(languages)):
        own = v[number == i]
        c = own[rng.choice(len(own), min(clusters, len(own)), replace=False)]
        for _ in range(rounds):
            nearest = (own @ c.T).argmax(1)
            c = np.stack([own[nearest == j].sum(0) if (nearest == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        centroids.append(c)
        of += [i] * len(c)
    centroids, of = np.concatenate(centroids).astype(np.float32), np.array(of)
    cos = v @ centroids.T
    least = [cos[number == i][:, of == i].max(1).min() * margin for i in range(len(languages))]
    return Model(languages, idf, centroids, of, np.array(least))


def train(docs: DataFrame, chosen: Column, *, key: str = "doc_id", text: str = "text", label: str = "lang", sample_rows: int = 400, most_labels: int = 4096, **how) -> Model | None:
    """A model of the rows where `chosen` holds and label and text are not null: for each label, the sample_rows rows
    whose ids hash lowest. More than most_labels labels are an error, none is left out. What reaches the driver is bounded: languages x sample_rows feature counts, whatever the texts' lengths."""
    usable = docs.where(chosen & docs[label].isNotNull() & docs[text].isNotNull() & docs[text].rlike(LETTER))
    ids = usable.select(docs[label].alias("label"), F.xxhash64(docs[key], F.lit(11)).alias("h"))
    # the cut of each label by an aggregate that keeps a count, not by a window over all its rows
    cut = ids.groupBy("label").agg(F.count("*").alias("n"))
    known = cut.count()
    if not known:
        return None
    if known > most_labels:
        raise ValueError(f"{known} labels, more than the {most_labels} that a model may have")
    # a hash is uniform, so this share of its range has about twice the rows wanted; the rest is cut exactly below
    share = F.lit(2.0 * sample_rows + 50) / F.col("n")
    least = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long"))
    h = F.xxhash64(docs[key], F.lit(11))
    hashed = usable.select(docs[label].alias("label"), h.alias("h"), docs[text].alias("text"))
    some = hashed.join(F.broadcast(cut.select("label", least.alias("least"))), "label").where("h <= least").select("label", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            for lo, hi, part, at in chunks(raw, offsets):
                found = counts(part, at)
                packed = []
                for row in found:
                    places = np.flatnonzero(row)
                    packed.append(places.astype("<u2").tobytes() + row[places].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(packed, pa.binary())], ["label", "h", "counts"])

    rows = some.mapInArrow(run, "label string, h long, counts binary").collect()
    rows.sort(key=lambda r: (r["label"], r["h"], r["counts"]))
    taken: dict[str, list] = {}
    for r in rows:
        if len(taken.setdefault(r["label"], [])) < sample_rows:
            taken[r["label"]].append(r["counts"])
    labels, found = [], []
    for name, packed in taken.items():
        for p in packed:
            n = len(p) // 6
            row = np.zeros(PLACES, np.float32)
            row[np.frombuffer(p[: 2 * n], "<u2")] = np.frombuffer(p[2 * n :], "<f4")
            found.append(row)
            labels.append(name)
    return fit(np.stack(found), labels, **how) if labels else None


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted"), keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all by default) with the prediction, its cosine clipped to 0..1, and whether the distance
    accepts it. Columns of these names are replaced. A map over the scan; the model (at most `most_labels` languages) goes with the tasks."""
    clash = [c for c in docs.columns if c in names]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in clash]
    picked = docs.select(*[docs[c] for c in kept], F.coalesce(docs[text].rlike(LETTER), F.lit(False)).alias("__letter"), docs[text].alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at_letter, at_text = len(kept), len(kept) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = buffers(batch.column(at_text))
            letter = np.asarray(batch.column(at_letter).to_numpy(zero_copy_only=False), bool)
            for lo, hi, part, at in chunks(raw, offsets):
                said, score, fine = [UND] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                if m is not None:
                    # in slices, as a row's counts take 32 KB
                    for a in range(0, hi - lo, 512):
                        b = min(hi - lo, a + 512)
                        cos = vectors(counts(part[at[a] : at[b]], at[a : b + 1] - at[a]), m.idf) @ m.centroids.T
                        best = cos.argmax(1)
                        which, top = m.of[best], cos.max(1)
                        has = letter[lo + a : lo + b]
                        score[a:b] = np.where(has, np.clip(top, 0, 1), 0)
                        fine[a:b] = has & (top >= m.floor[which])
                        said[a:b] = [m.languages[w] if h else UND for w, h in zip(which.tolist(), has.tolist(), strict=True)]
                columns = [batch.column(i)[lo:hi] for i in range(at_letter)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(fine, pa.bool_())], [*kept, *names])

    schema = picked.select(*kept).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")
    return picked.mapInArrow(run, schema)
