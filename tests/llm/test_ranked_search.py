"""Ranked search against scoring everything."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tapeframe.llm import ranked_search as rs
from tapeframe.llm.terms import hashed
from tapeframe.llm.textbytes import buffers

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, queries, k):
    held = [(i, Counter(t)) for i, t in ((i, terms_of(t)) for i, t in docs) if t]
    n = len(held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * m + 1))) for t, m in df.items()}
    out = []
    for q, text in queries:
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if score > 0:
                found.append((i, score))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(found[:k])]
    return out


def sample(n=400, seed=3):
    rnd = np.random.default_rng(seed)
    vocabulary = ["the", "of", "and", "Éa", "to"] + ["w%d" % i for i in range(300)]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(0, None), (1, ""), (2, " ..;\n"), (3, "The THE the"), (None, "w1 w2 w3"), (None, "w1 w2 w3")]
    rows += [(7, "w5 w6"), (7, "w5 w6"), (5, "x" * 70000 + " w9"), (6, "w7," * 30000)]
    for i in range(10, n):
        text = " ".join(rnd.choice(vocabulary, rnd.integers(3, 60), p=weights / weights.sum()))
        rows.append((i, text if i % 7 else rows[-1][1]))
    queries = [(0, "the w1 w2 w3"), (1, None), (2, "--"), (3, "nowhere"), (4, "w5-w6"), (4, "w5-w6"), (None, "OF And"), (5, " ".join(vocabulary))]
    queries += [(10 + i, " ".join(rnd.choice(vocabulary, 12))) for i in range(20)]
    return rows, queries


@pytest.mark.parametrize("shard_bytes,common", [(16 << 20, 48), (2000, 48), (6000, 0)])
def test_equals_scoring_everything(spark, shard_bytes, common):
    rows, queries = sample()
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, rank string").repartition(3)
    items = spark.createDataFrame([(*q, "y") for q in queries], "item_id long, text string, query string")
    got = rs.ranked(docs, items, k=10, shard_bytes=shard_bytes, common=common)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, queries, 10), key=key)


def test_empty_tables(spark):
    rows, queries = sample(20)
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    assert rs.ranked(docs.where("false"), items).count() == 0
    assert rs.ranked(docs, items.where("false")).count() == 0


def test_corners_hold_every_joint_maximum():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        a, b = rnd.integers(1, 1000, n), rnd.integers(1, 1000, n)
        points = np.array(rs.corners(a, b))
        for w in rnd.integers(0, 50, (40, 2)):
            assert (points @ w).max() == (a * w[0] + b * w[1]).max()


def test_pair_bounds_skip_work_beyond_single_maxima(tmp_path, monkeypatch):
    """Frequent terms that hardly ever meet: with pairs fewer postings are read, results are the same."""
    rnd = np.random.default_rng(7)
    texts = []
    for i in range(6000):
        side = ["aa", "bb", "cc", "dd"][i % 4]
        texts.append(" ".join([side] + ["z%d" % rnd.integers(3000) for _ in range(6)] + (["rare"] if i % 97 == 0 else []) + (["aa", "bb"] if i % 1000 == 0 else [])))
    raw, offsets = buffers(pa.array(texts))
    h, _, _, row = hashed(raw, offsets, rs.CUT)
    of = rs.Collection(len(texts), len(h))
    shards = []
    for common in (48, 0):
        arrays = rs.shard_arrays(h, row, np.arange(len(texts)), np.zeros(len(texts), bool), of, common=common)
        shards.append(rs.Shard(rs._written(f"file://{tmp_path}", arrays)))
    q, w = np.unique(hashed(*buffers(pa.array(["rare aa bb cc dd"])), rs.CUT)[0], return_counts=True)
    df = np.diff(shards[0].ends)[shards[0].places(q)]
    w = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * n + 1))) for n in df])
    work = [rs.Work(), rs.Work()]
    found = [rs.search(s, q, w, 50, x) for s, x in zip(shards, work)]
    best = [sorted(zip((-s).tolist(), r.tolist()))[:50] for r, s in found]
    assert best[0] == best[1] and len(best[0]) == 50
    assert work[0].read + work[0].pair_lists < work[1].read <= work[1].postings
