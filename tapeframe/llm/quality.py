"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a boolean expression that is true for a text to reject. On a bounded sample of rows the cascade measures what a
rule costs (seconds for the sample) and how many rows it rejects, and puts the rules in order of rejections per second; a row then
pays only for the rules up to the first that rejects it (a conditional expression evaluates no further branch). The order
decides about time, never about the verdict, as a text is rejected if any rule rejects it.

Words are runs of characters other than space and \\t \\n \\v \\f \\r. Null counts as a text without words: rejected by
"few_words". Very long texts are judged whole. Equal rows get equal verdicts. An empty table or sample keeps the rules in the
given order. The text column may have any name; other columns are not looked at and all are kept.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeframe.sources.shared import settle

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Characters in words: all but the white space between them."""
    text = F.coalesce(text, F.lit(""))
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(text: Column, k: int = 5) -> Column:
    """Words in runs of k words that stand twice or more in the text, the first time included.

    Runs are compared by 64-bit hashes. Most texts repeat none: the number of different hashes shows it. Only for
    the others are the hashes sorted with their places, and the places of equal neighbours joined to stretches.
    """

    def of(w: Column) -> Column:
        n = F.size(w) - (k - 1)
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n < 2, F.lit(0)).otherwise(let(runs, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(F.transform(s, lambda x, i: F.when((x.h == F.get(s, i - 1).h) | (x.h == F.get(s, i + 1).h), x.i)), lambda x: x.isNotNull()))
        gaps = let(F.array_sort(twice), lambda p: F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    return let(words(text), of).cast("long")


@dataclass(frozen=True)
class Rule:
    """reject: from a text column to a boolean column that is never null."""

    name: str
    reject: object


# The thresholds are parameters of the rules; a rule named here is one that `cascade` may put in any order.
def default_rules(*, least_words: int = 10, repeat_percent: int = 20, symbol_percent: int = 10, dup_line_percent: int = 40, least_mean: float = 2.0, most_mean: float = 15.0) -> list[Rule]:
    def mean_length(text: Column) -> Column:
        chars, words_in = word_chars(text), n_words(text)
        return let(F.struct(chars.alias("c"), words_in.alias("n")), lambda x: (x.n > 0) & ((x.c < least_mean * x.n) | (x.c > most_mean * x.n)))

    def lines(text: Column) -> Column:
        return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))

    return [
        Rule("few_words", lambda t: n_words(t) < least_words),
        Rule("repeated_runs", lambda t: 100 * n_repeat_words(t) > repeat_percent * n_words(t)),
        Rule("symbols", lambda t: 100 * n_symbols(t) > symbol_percent * n_words(t)),
        Rule("repeated_lines", lambda t: 100 * n_dup_lines(t) > dup_line_percent * lines(t)),
        Rule("word_length", mean_length),
    ]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: int

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def measure(docs: DataFrame, rules: Sequence[Rule], *, text: str = "text", sample_rows: int = 400) -> list[Measured]:
    """Cost and rejections of each rule over at most sample_rows rows, best first. Reading the sample is timed
    apart and taken off; ties keep the given order."""
    sample = settle(docs.select(docs[text].alias("t")).limit(sample_rows))

    def timed(test: Column | None) -> tuple[float, int]:
        began = time.perf_counter()
        got = sample.agg(F.count_if(F.lit(False) if test is None else test)).first()[0]
        return time.perf_counter() - began, got

    timed(None)
    least = timed(None)[0]
    out = []
    for rule in rules:
        seconds, rejected = timed(rule.reject(F.col("t")))
        out.append(Measured(rule, max(1e-4, seconds - least), rejected))
    return sorted(out, key=lambda m: -m.worth)


def verdict(rules: Sequence[Rule], text: Column) -> Column:
    """The first rule in this order that rejects, null for a text that is kept."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.reject(text), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, *, text: str = "text", sample_rows: int = 400, reason: str = "rejected_by") -> DataFrame:
    """docs with the column `reason`: a rule that rejects the text, or null. A map over the scan."""
    ordered = [m.rule for m in measure(docs, default_rules() if rules is None else rules, text=text, sample_rows=sample_rows)]
    return docs.withColumn(reason, verdict(ordered, docs[text]))


def kept_only(docs: DataFrame, rules: Sequence[Rule] | None = None, *, text: str = "text", sample_rows: int = 400) -> DataFrame:
    """The rows that no rule rejects, columns unchanged."""
    ordered = [m.rule for m in measure(docs, default_rules() if rules is None else rules, text=text, sample_rows=sample_rows)]
    return docs.where(verdict(ordered, docs[text]).isNull())
