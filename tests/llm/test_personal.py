"""Rules against plain regular expressions; the field against all ways to cut a window; what it adds."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tapeframe.llm import personal as pe

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def card(rnd, size=16):
    digits = [rnd.randrange(10) for _ in range(size - 1)]
    for last in "0123456789":
        if pe.luhn("".join(map(str, digits)) + last):
            return "".join(map(str, digits)) + last


def phone(rnd):
    return f"+{rnd.randrange(1, 99)} ({rnd.randrange(100, 999)}) {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}"


def address(rnd):
    return ".".join(str(rnd.randrange(256)) for _ in range(4))


def texts(n=400, seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghiéñ", k=rnd.randint(1, 8)))
    things = [lambda: card(rnd), lambda: phone(rnd), lambda: address(rnd), lambda: f"{rnd.choice(['ann', 'bob', 'x'])}.{rnd.randrange(99)}@mail{rnd.randrange(9)}.example.com", lambda: str(rnd.randrange(10**16)).zfill(16), lambda: str(rnd.randrange(10**7)), word]
    return [" ".join(rnd.choice(things)() if rnd.random() < 0.15 else word() for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_rules_equal_plain_expressions():
    rnd = random.Random(1)
    cases = ["", "a@b.c@d.e", "a@b@c.d", "@x.y", "a@b..c", "a@b.c.", "1.2.3.4.5.6.7.8", "1.2.3.256", "0001.02.3.4", "+1", "+1 ", "+1 2+3 4567890", "++12345678", "1-2 3--4", "é@b.c", "٣@x.y", "4 5" * 10]
    cases += ["".join(rnd.choices("0019.+-@ (ab)", k=rnd.randint(0, 60))) for _ in range(3000)] + texts(100)
    for text in cases:
        assert pe.rules(text)[0] == plain(text), text


def test_rules_are_linear_on_long_texts():
    for text in ("a" * 300_000, "1" * 300_000, "1.2." * 100_000, "+1 " * 100_000, "a@" * 100_000, "1 " * 150_000, "+" * 300_000):
        pe.rules(text)
        pe.regions(text)


def ways(lat):
    """All ways to cut a window: lists of (segment, kind)."""

    def onward(t):
        if t == lat.size:
            yield []
            return
        for rest in onward(t + 1):
            yield rest
        for c, (i, j, _, kinds) in enumerate(lat.segments):
            if i == t:
                for y, rest in itertools.product(kinds, onward(j)):
                    yield [(c, y), *rest]

    return list(onward(0))


def worth(model, lat, way):
    out, t, label = 0.0, 0, pe.OUTSIDE
    inside = {lat.segments[c][0]: (c, y) for c, y in way}
    while t < lat.size:
        c, y = inside.get(t, (-1, pe.OUTSIDE))
        out += model.moves[label, y]
        if c >= 0:
            out += sum(model.weights[model.names[f], y] for f in lat.segments[c][2])
        t, label = (lat.segments[c][1] if c >= 0 else t + 1), y
    return out


@pytest.fixture(scope="module")
def windows():
    some = []
    for text in ["+1 (415) 555-0123 1.2.3.4", "4539148803436467 12", "x.1@a.b.cc 5", "1.22.33.4 5678901", "a (at) b.cc"]:
        a, b = pe.regions(text)[0]
        some.append(pe.lattice(text, a, b))
    names = {f: i for i, f in enumerate(sorted({f for lat in some for s in lat.segments for f in s[2]}))}
    rng = np.random.default_rng(3)
    return some, pe.Model(names, rng.normal(0, 1, (len(names), 4)), rng.normal(0, 1, (5, 5)))


def test_field_equals_all_ways(windows):
    some, model = windows
    every = [ways(lat) for lat in some]
    assert all(len(w) > 1 for w in every) and sum(map(len, every)) > 60
    batch = pe.Windows([(lat, w[-1], n + 1) for n, (lat, w) in enumerate(zip(some, every))], model.names)
    sums = [np.logaddexp.reduce([worth(model, lat, x) for x in w]) for lat, w in zip(some, every)]
    assert np.allclose(batch.normaliser(model), sums)
    value, *_ = batch.likelihood(model)
    assert np.isclose(value, sum((n + 1) * (worth(model, lat, w[-1]) - z) for n, (lat, w, z) in enumerate(zip(some, every, sums))))
    for lat, w in zip(some, every):
        assert np.isclose(worth(model, lat, pe.best(model, lat)), max(worth(model, lat, x) for x in w))


def test_gradient_by_differences(windows):
    some, model = windows
    batch = pe.Windows([(lat, ways(lat)[-1], n + 1) for n, lat in enumerate(some)], model.names)
    _, weights, moves = batch.likelihood(model)
    rng = np.random.default_rng(9)
    for x, g in ((model.weights, weights), (model.moves, moves)):
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in x.shape)
            x[at] += 1e-5
            up, *_ = batch.likelihood(model)
            x[at] -= 2e-5
            down, *_ = batch.likelihood(model)
            x[at] += 1e-5
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    return pe.train(docs)


def test_field_agrees_with_the_rules_on_other_texts(model):
    hits = wanted = given = 0
    for text in texts(300, seed=11):
        gold, long = pe.rules(text)
        got = set()
        for a, b in pe.regions(text):
            if not any(x < b and a < y for x, y in long):
                lat = pe.lattice(text, a, b)
                got |= {(pe.KINDS[y], lat.places[lat.segments[c][0]], lat.places[lat.segments[c][1]]) for c, y in pe.best(model, lat)}
        gold = {x for x in gold if not any(y < x[2] and x[1] < z for y, z in long)}
        hits, wanted, given = hits + len(got & gold), wanted + len(gold), given + len(got)
    assert wanted > 200 and hits / wanted > 0.98 and hits / given > 0.97


def test_field_adds_what_rules_cannot_cut(model):
    rnd = random.Random(8)
    added = lambda text: [(k, text[s:e]) for k, s, e in pe.find(text, model)[1] if (k, s, e) not in pe.find(text, model)[0]]
    a, b, p, i = card(rnd), card(rnd), phone(rnd), address(rnd)
    assert added(f"pay {a} {b} now") == [("card", a), ("card", b)]
    assert added(f"call {p} {i} now") == [("phone", p)]
    grouped = " ".join(a[x : x + 4] for x in range(0, 16, 4))
    assert added(f"pay {grouped} 2031 now") == [("card", grouped)]
    for clean in ("1234567890123456", "1 2 3 4 5 6 7 8 9 10 11 12 13", "2012 2013 2014 2015 2016 2017", "3.14159 2.71828", "2012-05-17 2013-05-17", "v 1.2.3 and 10.4.5", "x" * 5000, "meet at noon. dot. at. 7"):
        assert pe.find(clean, model) == ([], [])


def test_rows(spark, model):
    rows = [(0, None), (1, ""), (None, "ä +1 (415) 555-0123, a.b@c.de 1.2.3.4"), (3, "w " * 100_000 + "a@b.cc"), (4, "12 " * 20_000), (3, "w " * 100_000 + "a@b.cc")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_email long, spans string").repartition(2)
    got = sorted(pe.scan(docs, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [r["doc_id"] for r in got] == [0, 1, 3, 3, 4, None]
    assert tuple(got[0])[1:] == tuple(got[1])[1:] == (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert got[2] == got[3] and got[2]["spans"] == "email:200000:200006" and got[4]["spans"] == ""
    spans = "email:21:29,ip:30:37,phone:2:19"
    assert tuple(got[5])[1:] == (1, 1, 0, 1, hashlib.sha256(b"email:21:29,ip:30:37,phone:2:19").hexdigest(), spans)
    assert pe.scan(docs.where("false"), model).count() == 0
    nothing = pe.train(docs.where("false"))
    assert pe.find("pay 4539148803436467 4539148803436467", nothing) == ([], [])
