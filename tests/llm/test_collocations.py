"""Collocations against counting everything."""

import re
from collections import Counter

import numpy as np
import pytest

from tapeframe.llm import collocations as co

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, percent, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    phrases = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, w), a in phrases.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner = (lang, w[i : i + m])
                if 100 * a >= percent * phrases[inner]:
                    dropped.add(inner)
    out = {}
    for (lang, w), a in phrases.items():
        if (lang, w) in dropped:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, r) in enumerate(sorted(found)[:top]))


def sample(n=300, seed=2):
    rnd = np.random.default_rng(seed)
    vocabulary = np.array(["The", "of", "new", "york", "city", "Ñu", "a"] + ["v%d" % i for i in range(40)])
    p = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(None, "en"), ("", None), (" .,;\n", "en"), ("a a a a\ta A a", None), ("z" * 5000, "xx"), ("q r " * 20000, "xx")]
    for i in range(n):
        words = rnd.choice(vocabulary, rnd.integers(1, 50), p=p / p.sum())
        text = " ".join(words) + " new york city" * int(rnd.integers(0, 3)) + rnd.choice([". ", ", ", "\n", " "]) + "of the v1"
        rows.append((text, ["en", "de", None][i % 3]))
    return rows + rows[50:60]


@pytest.mark.parametrize("longest,bucket_tokens,top", [(3, 2_000_000, 2000), (3, 1, 50), (2, 300, 2000), (4, 100, 2000)])
def test_equals_counting_everything(spark, longest, bucket_tokens, top, monkeypatch):
    rows = sample()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, n long, words string").repartition(3)
    got = co.collocations(docs, longest=longest, bucket_tokens=bucket_tokens, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, longest, 50, top)


def test_empty_and_small_filter(spark):
    rows = sample(60)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert co.collocations(docs.where("false")).count() == 0
    got = co.collocations(docs, least=2, subsumed_percent=80, filter_bits=1 << 9)  # a full filter lets everything through
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 3, 80, 2000)


def test_scores_beyond_64_bits(spark):
    big = 5_000_000_000
    phrases = spark.createDataFrame([("en", [1, 2], big)], "lang string, words array<long>, a long")
    counts = spark.createDataFrame([("en", [1], 7 * big), ("en", [2], 3 * big)], "lang string, words array<long>, n long")
    assert co.scored(phrases, counts).first()["score"] == 1_000_000 * big * big // (21 * big * big)


def test_stripes_survive_packing():
    rnd = np.random.default_rng(1)
    for width in (1, 2):
        prefix = np.sort(rnd.integers(0, 9, (500, width)).astype(np.uint64), axis=0)
        following, n = rnd.integers(0, 2**63, 500).astype(np.uint64), rnd.integers(1, 2**32, 500)
        got = co._unpacked(co._packed(prefix, following, n), width)
        assert all((a == b).all() for a, b in zip(got, (prefix, following, n)))
