"""Personal data by rules and a semi-Markov conditional random field.

Rules find emails, IP addresses, card numbers and phone numbers that stand in plain form. Around every number of some length and every
at-sign, the field then looks for what the rules can't cut out: two cards in one run of digits, a card with a year behind it, a phone
number that runs into an address, an at-sign in brackets. Its segments are runs of at most MAX_TOKENS tokens, and its features see a
segment whole: how many digits, in which groups, which separators, whether the check digit is right, whether all parts are octets, what stands
left and right of it. Dynamic programming over (place, type) picks boundaries and types together; a token outside scores 0.

The field is trained by conditional likelihood on windows around candidates in at most about `sample_rows` rows (chosen by hash), labelled by the rules;
windows where a rule's match is longer than the kind allows are left out, as the rule can't say what is in them. Copies of
phone numbers without their plus sign and of cards in groups of four teach the field not to rest on one form, made-up lists of numbers what is no one's. Windows of one shape are one, with a count; at most
`shapes` of them, the most frequent, reach the driver. What the rules found stays, and nothing that overlaps it is added.

Places are code points, ends exclusive. Null texts are empty and have none. Whole texts are read, by linear scans. Equal texts have equal
spans; repeated and null ids are rows of their own. Without anything to learn from, nothing is added. Other columns are not looked
at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MAX_TOKENS = 24
MAX_GAP = 3  # characters between two groups of digits of one segment


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rules(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(what the rules find, by kind and start; matches too long for their kind). Each kind is matched for itself, leftmost, none overlapping."""
    found: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    long: list[tuple[int, int]] = []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        size = m.end() - m.start()
        if size >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
            elif len(digits) > 19:
                long.append(m.span())
    at = text.find("+")
    while at >= 0:
        if m := PHONE.match(text, at):
            n = len(_digits(m.group()))
            if 8 <= n <= 15:
                found.append(("phone", *m.span()))
            elif n > 15:
                long.append(m.span())
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return found, long


# --- candidates

NUMBER = re.compile(r"[0-9][0-9 \t().+\-/\[\]]*")
AT = re.compile(r"@|[(\[][aA][tT][)\]]")
AFTER_AT = re.compile(r" ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[][dD][oO][tT][)\]]) ?[A-Za-z0-9-]+)+")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7F]+|[ \t]+|(?s:.)")
DOT = re.compile(r"\.|[(\[][dD][oO][tT][)\]]")


def regions(text: str) -> list[tuple[int, int]]:
    """Where segments can be: runs of digits and their separators, and what is around at-signs. Disjoint, ascending."""
    found = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        run = m.group()
        if len(_digits(run)) < 7 and run.count(".") < 3:
            continue
        a, b = m.span()
        while a > 0 and m.start() - a < 2 and text[a - 1] in "+([":
            a -= 1
        found.append((a, b))
    for m in AT.finditer(text):
        if after := AFTER_AT.match(text, m.end()):
            a = m.start()
            if a > 0 and text[a - 1] == " ":
                a -= 1
            low = max(0, a - 64)
            while a > low and text[a - 1] in LOCAL:
                a -= 1
            found.append((a, after.end()))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kind_of_char(text: str, at: int) -> str:
    if at < 0 or at >= len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else c if c < "\x7f" else "other"


def number_features(text: str, a: int, b: int) -> list[str]:
    """A segment of digits and separators, seen whole."""
    span = text[a:b]
    groups = re.findall(r"[0-9]+", span)
    gaps = sorted(set(re.split(r"[0-9]+", span)[1:-1]))
    digits = "".join(groups)
    n = len(digits)
    shape = "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    out = ["number", f"digits {n}", f"groups {shape}", f"gaps {'|'.join(gaps)}", f"first {span[0] if span[0] in '+([' else 'digit'}", f"left {_kind_of_char(text, a - 1)}", f"right {_kind_of_char(text, b)}"]
    if 12 <= n <= 19:
        out += [f"check {luhn(digits)}", f"check {luhn(digits)} of {n}"]
    if len(groups) == 4 and gaps == ["."]:
        out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if span[0] == "+":
        out.append(f"plus {8 <= n <= 15}")
    return out


def address_features(text: str, a: int, b: int, at: tuple[int, int]) -> list[str]:
    """A segment around an at-sign, seen whole."""
    name, sign, domain = text[a : at[0]], text[at[0] : at[1]], text[at[1] : b]
    labels = [x.strip() for x in DOT.split(domain)]
    out = ["address", f"sign {sign.lower()}", f"spaces {name.endswith(' ')} {' ' in domain}", f"labels {min(len(labels), 5)}", f"top {labels[-1].isalpha()} {min(len(labels[-1]), 4)}"]
    return [*out, f"name {name.strip()[:1].isalnum()}", f"left {_kind_of_char(text, a - 1)}", f"right {_kind_of_char(text, b)}"]


@dataclass
class Lattice:
    """A window: its tokens' ends, and candidate segments (first token, token after the last, features, kinds they may be)."""

    places: list[int]  # where tokens begin, and the end of the last
    segments: list[tuple[int, int, tuple[str, ...], tuple[int, ...]]] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.places) - 1


def lattice(text: str, a: int, b: int, taken: Sequence[tuple[int, int]] = ()) -> Lattice:
    """All candidate segments of text[a:b] that overlap nothing taken."""
    spans = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
    out = Lattice([s for s, _ in spans] + [b])
    free = [not any(s < y and x < e for x, y in taken) for s, e in spans]
    numeric = ["0" <= text[s] <= "9" for s, _ in spans]
    filler = [not n and all(c in " \t().+-/[]" for c in text[s:e]) for n, (s, e) in zip(numeric, spans, strict=True)]
    for i, (s, _) in enumerate(spans):
        if not free[i] or not (numeric[i] or text[s] in "+(["):
            continue
        digits = groups = 0
        last = s
        for j in range(i, min(len(spans), i + MAX_TOKENS)):
            if not free[j] or not (numeric[j] or filler[j]):
                break
            if numeric[j]:
                if groups and spans[j][0] - last > MAX_GAP or not groups and spans[j][0] - s > MAX_GAP:
                    break
                digits += spans[j][1] - spans[j][0]
                groups += 1
                last = spans[j][1]
                if digits > 19:
                    break
                kinds = ((1,) if groups == 4 and digits <= 12 else ()) + ((2,) if digits >= 13 and groups <= 5 else ()) + ((3,) if 7 <= digits <= 15 and groups <= 6 else ())
                if kinds:
                    out.segments.append((i, j + 1, tuple(number_features(text, s, last)), kinds))
    for m in AT.finditer(text, a, b):
        first = [i for i, (s, e) in enumerate(spans) if s < m.start() and m.start() - s <= 64 and text[s].isalnum()]
        last = [j for j, (s, e) in enumerate(spans) if s >= m.end() and text[s].isalnum()]
        for i in first:
            name = text[spans[i][0] : m.start()]
            if any(c not in LOCAL for c in name.removesuffix(" ")):
                continue
            for j in last:
                domain = text[m.end() : spans[j][1]]
                if AFTER_AT.fullmatch(domain) and j + 1 - i <= MAX_TOKENS and all(free[i : j + 1]):
                    out.segments.append((i, j + 1, tuple(address_features(text, spans[i][0], spans[j][1], m.span())), (0,)))
    return out


# --- the field

LABELS = len(KINDS) + 1  # the last is 'outside', whose segments are single tokens
OUTSIDE = len(KINDS)


@dataclass
class Model:
    names: dict[str, int]
    weights: np.ndarray  # feature x kind
    moves: np.ndarray  # label before x label


def _scores(model: Model, lat: Lattice) -> list[np.ndarray]:
    """Per segment its score by kind, -inf for kinds it can't be."""
    out = []
    for _, _, features, kinds in lat.segments:
        s = np.full(len(KINDS), -np.inf)
        ids = [model.names[f] for f in features if f in model.names]
        s[list(kinds)] = model.weights[ids].sum(0)[list(kinds)]
        out.append(s)
    return out


def _starts(lat: Lattice) -> list[list[int]]:
    """The segments that begin at each token."""
    out: list[list[int]] = [[] for _ in range(lat.size)]
    for c, (i, *_) in enumerate(lat.segments):
        out[i].append(c)
    return out


def best(model: Model, lat: Lattice) -> list[tuple[int, int]]:
    """The segments of the best way as (number, kind); outside wins ties."""
    scores, starts = _scores(model, lat), _starts(lat)
    top = np.full((lat.size + 1, LABELS), -np.inf)
    top[0, OUTSIDE] = 0.0
    back: dict[tuple[int, int], tuple[int, int, int]] = {}  # (place, label) -> (place before, label before, segment)
    for t in range(lat.size):
        if not np.isfinite(top[t]).any():
            continue
        ways = top[t][:, None] + model.moves
        before = LABELS - 1 - ways[::-1].argmax(0)
        into = ways[before, np.arange(LABELS)]
        if into[OUTSIDE] > top[t + 1, OUTSIDE]:
            top[t + 1, OUTSIDE] = into[OUTSIDE]
            back[t + 1, OUTSIDE] = (t, int(before[OUTSIDE]), -1)
        for c in starts[t]:
            j = lat.segments[c][1]
            for y in lat.segments[c][3]:
                if (s := into[y] + scores[c][y]) > top[j, y]:
                    top[j, y] = s
                    back[j, y] = (t, int(before[y]), c)
    out, at, label = [], lat.size, int(LABELS - 1 - top[lat.size][::-1].argmax())
    while at:
        at, label_before, c = back[at, label]
        if c >= 0:
            out.append((c, label))
        label = label_before
    return out[::-1]


class Windows:
    """Windows of (lattice, gold segments as (number, kind), frequency) side by side; all of them take a step of the recursions at once."""

    def __init__(self, windows: Sequence[tuple[Lattice, Sequence[tuple[int, int]], float]], names: dict[str, int]):
        self.sizes = np.array([lat.size for lat, _, _ in windows])
        self.scale = np.array([n for _, _, n in windows], float)
        rows = [(w, *s) for w, (lat, _, _) in enumerate(windows) for s in lat.segments]
        self.of, self.start, self.end = (np.array([r[x] for r in rows], int) for x in (0, 1, 2))
        self.allowed = np.zeros((len(rows), len(KINDS)), bool)
        for c, r in enumerate(rows):
            self.allowed[c, list(r[4])] = True
        self.ids = np.array([names[f] for r in rows for f in r[3]], int)
        self.lengths = np.array([len(r[3]) for r in rows], int)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.at = [np.flatnonzero(self.start == t) for t in range(int(self.sizes.max()))]
        self.gold = np.zeros((len(rows), len(KINDS)))
        self.gold_moves = np.zeros((len(windows), LABELS, LABELS))
        offset = 0
        for w, (lat, gold, _) in enumerate(windows):
            inside, t, label = {lat.segments[c][0]: (c, y) for c, y in gold}, 0, OUTSIDE
            while t < lat.size:
                c, y = inside.get(t, (-1, OUTSIDE))
                self.gold_moves[w, label, y] += 1
                if c >= 0:
                    self.gold[offset + c, y] = 1
                t, label = (lat.segments[c][1] if c >= 0 else t + 1), y
            offset += len(lat.segments)

    def _scores(self, model: Model) -> np.ndarray:
        return np.where(self.allowed, np.add.reduceat(model.weights[self.ids], self.first, axis=0), -np.inf)

    def forward(self, model: Model, scores: np.ndarray) -> np.ndarray:
        """[window, place, label of the segment that ends there]: log of the summed weights of all ways to get there."""
        alpha = np.full((len(self.sizes), self.sizes.max() + 1, LABELS), -np.inf)
        alpha[:, 0, OUTSIDE] = 0.0
        for t, some in enumerate(self.at):
            into = np.logaddexp.reduce(alpha[:, t, :, None] + model.moves, axis=1)
            alpha[:, t + 1, OUTSIDE] = np.logaddexp(alpha[:, t + 1, OUTSIDE], into[:, OUTSIDE])
            w, j = self.of[some], self.end[some]
            alpha[w, j, :OUTSIDE] = np.logaddexp(alpha[w, j, :OUTSIDE], into[w, :OUTSIDE] + scores[some])
        return alpha

    def backward(self, model: Model, scores: np.ndarray) -> np.ndarray:
        """[window, place, label of the segment that ends there]: log of the summed weights of all ways on to the end."""
        windows = np.arange(len(self.sizes))
        beta = np.full((len(self.sizes), self.sizes.max() + 1, LABELS), -np.inf)
        beta[windows, self.sizes] = 0.0
        for t in range(len(self.at) - 1, -1, -1):
            some, live = self.at[t], t < self.sizes
            onward = np.full((len(self.sizes), LABELS), -np.inf)
            onward[:, OUTSIDE] = beta[:, t + 1, OUTSIDE]
            for y in range(OUTSIDE):  # segments of a window that begin at one place
                np.logaddexp.at(onward[:, y], self.of[some], scores[some, y] + beta[self.of[some], self.end[some], y])
            beta[live, t] = np.logaddexp.reduce(model.moves[None] + onward[live, None, :], axis=2)
        return beta

    def normaliser(self, model: Model) -> np.ndarray:
        alpha = self.forward(model, self._scores(model))
        return np.logaddexp.reduce(alpha[np.arange(len(self.sizes)), self.sizes], axis=1)

    def likelihood(self, model: Model) -> tuple[float, np.ndarray, np.ndarray]:
        """(log probability of the gold segments over all windows, by frequency, and its gradient by weights and by moves)."""
        scores = self._scores(model)
        alpha, beta = self.forward(model, scores), self.backward(model, scores)
        z = np.logaddexp.reduce(alpha[np.arange(len(self.sizes)), self.sizes], axis=1)
        value = (self.scale * ((self.gold_moves * model.moves).sum((1, 2)) - z)).sum()
        value += (np.where(self.gold > 0, scores, 0) * self.scale[self.of][:, None]).sum()
        moves = (self.gold_moves * self.scale[:, None, None]).sum(0)
        by_segment = self.gold * self.scale[self.of][:, None]
        for t, some in enumerate(self.at):
            live = np.flatnonzero(t < self.sizes)
            outside = np.exp(alpha[live, t] + model.moves[:, OUTSIDE] + (beta[live, t + 1, OUTSIDE] - z[live])[:, None])
            moves[:, OUTSIDE] -= (outside * self.scale[live][:, None]).sum(0)
            if len(some):
                w, j = self.of[some], self.end[some]
                p = np.exp(alpha[w, t][:, :, None] + model.moves[None, :, :OUTSIDE] + (scores[some] + beta[w, j, :OUTSIDE] - z[w][:, None])[:, None, :]) * self.scale[w][:, None, None]
                moves[:, :OUTSIDE] -= p.sum(0)
                by_segment[some] -= p.sum(1)
        weights = np.zeros_like(model.weights)
        np.add.at(weights, self.ids, np.repeat(by_segment, self.lengths, axis=0))
        return float(value), weights, moves


def fit(shapes: Sequence[tuple[Lattice, Sequence[tuple[int, int]], int]], *, rounds: int = 120, step: float = 0.25, penalty: float = 0.02) -> Model:
    """Maximises the windows' penalised likelihood by a fixed number of adaptive gradient steps. A shape counts by the logarithm of its
    frequency, so that the commonest form does not drown the others. Without shapes nothing is ever inside."""
    names = {f: i for i, f in enumerate(sorted({f for lat, _, _ in shapes for s in lat.segments for f in s[2]}))}
    model = Model(names, np.zeros((len(names), len(KINDS))), np.zeros((LABELS, LABELS)))
    if not shapes:
        return model
    windows = Windows([(lat, gold, 1 + math.log(n)) for lat, gold, n in shapes], names)
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (model.weights, model.moves)]
    for r in range(1, rounds + 1):
        _, *gradients = windows.likelihood(model)
        for (x, m, v), gradient in zip(state, gradients, strict=True):
            g = gradient - penalty * x
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += step * (1 - r / (rounds + 1)) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return model


# --- training and use on tables


def labelled(text: str) -> Iterator[tuple[Lattice, list[tuple[int, int]]]]:
    """Windows of a text with the rules' spans as gold segments; windows of which the rules can't speak are left out."""
    found, long = rules(text)
    for a, b in regions(text):
        if any(x < b and a < y for x, y in long):
            continue
        own = sorted((s, e, KINDS.index(k)) for k, s, e in found if s < b and a < e)
        if any(s < a or e > b for s, e, _ in own) or any(x[1] > y[0] for x, y in zip(own, own[1:])):
            continue
        lat = lattice(text, a, b)
        if not lat.segments or lat.size > 3 * MAX_TOKENS:
            continue
        where = {(lat.places[i], lat.places[j]): c for c, (i, j, _, _) in enumerate(lat.segments)}
        if all((s, e) in where and y in lat.segments[where[s, e]][3] for s, e, y in own):
            yield lat, [(where[s, e], y) for s, e, y in own]


def variants(text: str) -> Iterator[tuple[Lattice, list[tuple[int, int]]]]:
    """What the rules found once more in another form: grouped phone numbers without plus sign, cards in groups of four."""
    for kind, s, e in rules(text)[0]:
        forms = []
        if kind == "phone" and re.search(r"[0-9][ ().-]+[0-9]", bare := text[s + 1 : e]):
            country = re.match(r"[0-9]{1,3}[ -]+", bare)
            forms = sorted({bare, bare[country.end() :] if country else bare})
        elif kind == "card" and text[s:e].isdigit():
            forms = [gap.join(text[i : min(i + 4, e)] for i in range(s, e, 4)) for gap in " -"]
        for form in forms:
            lat = lattice(f" {form} ", 1, 1 + len(form))
            whole = [c for c, (i, j, _, kinds) in enumerate(lat.segments) if (i, j) == (0, lat.size) and KINDS.index(kind) in kinds]
            if whole:
                yield lat, [(whole[0], KINDS.index(kind))]


def plain_numbers(count: int = 200, seed: int = 5) -> Iterator[tuple[Lattice, list[tuple[int, int]]]]:
    """Made-up lists, tables, dates and decimals, in which nothing is personal; those that have a card's form by chance are left out."""
    rnd = random.Random(seed)
    number = lambda lo, hi: str(rnd.randrange(10 ** rnd.randint(lo, hi)))
    forms = [
        lambda: number(1, 3),
        lambda: number(2, 2),
        lambda: number(4, 4),
        lambda: number(1, 6),
        lambda: f"{number(1, 3)}.{number(1, 5)}",
        lambda: f"{rnd.randrange(1900, 2100)}-{rnd.randrange(1, 13):02}-{rnd.randrange(1, 32):02}",
        lambda: f"{rnd.randrange(1, 32)}/{rnd.randrange(1, 13)}/{rnd.randrange(1900, 2100)}",
    ]
    for _ in range(count):
        gap, form = rnd.choice([" ", " ", " ", "  ", "-", "/", " - ", "\t"]), rnd.choice(forms)
        numbers = [form() for _ in range(rnd.randint(2, 12))]
        text = f" {gap.join(numbers)} "
        if not rules(text)[0]:
            lat = lattice(text, 1, len(text) - 1)
            if lat.segments and lat.size <= 3 * MAX_TOKENS and not any({"groups 4-4-4-4", "check True"} <= set(f) for _, _, f, _ in lat.segments):
                yield lat, []


def _shape(lat: Lattice, gold: list[tuple[int, int]]) -> str:
    return json.dumps([lat.size, lat.segments, gold])


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample_rows: int = 50_000, shapes: int = 1024) -> Model:
    """The field, from the rules' labels in a hash sample of about sample_rows rows."""
    n = docs.count()
    share = min(1.0, sample_rows / max(1, n))
    near = F.pmod(F.xxhash64(docs[key], docs[text]), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [_shape(*x) for t in batch.column(0).to_pylist() if t for f in (labelled, variants) for x in f(t)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["shape"])

    found = docs.where(near).select(docs[text].alias("text")).mapInArrow(run, "shape string").groupBy("shape").agg(F.count("*").alias("n"))
    rows = stored(found, "shapes").orderBy(F.desc("n"), "shape").limit(shapes).collect()
    windows = []
    for r in rows:
        size, segments, gold = json.loads(r["shape"])
        windows.append((Lattice(list(range(size + 1)), [(i, j, tuple(f), tuple(k)) for i, j, f, k in segments]), [tuple(g) for g in gold], r["n"]))
    return fit([*windows, *((lat, gold, 1) for lat, gold in plain_numbers())] if windows else [])


def find(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """(the rules' spans, all spans), by kind and start."""
    base, _ = rules(text)
    taken = [(s, e) for _, s, e in base]
    added: list[Span] = []
    for a, b in regions(text):
        near = [(s, e) for s, e in taken if s < b and a < e]
        if any(s <= a and e >= b for s, e in near):
            continue
        lat = lattice(text, a, b, near)
        if lat.segments:
            added += [(KINDS[y], lat.places[lat.segments[c][0]], lat.places[lat.segments[c][1]]) for c, y in best(model, lat)]
    order = lambda x: (KINDS.index(x[0]), x[1])
    return sorted(base, key=order), sorted(base + added, key=order)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, the number of the rules' spans of each kind, their digest, and all spans. A map over the scan."""
    schema = f"{key} long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    names = [key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for t in batch.column(1):
                base, every = find(t.as_py() or "", model)
                counts.append([sum(k == x[0] for x in base) for k in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return docs.select(docs[key].cast("long").alias(key), docs[text].alias("text")).mapInArrow(run, schema)
