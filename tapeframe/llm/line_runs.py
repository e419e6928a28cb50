"""Repeated runs of lines, found by a suffix array over the corpus's lines; later copies are deleted.

The sequence is the lines with a word, in order of (id, line); lines are equal as strings and blank ones stand
outside. A run is repeated if it also stands at an earlier place. A line is deleted if it lies in a repeated run of at least
`min_lines` lines, or is a repeated line of at least `min_words` words by itself. What stands first is kept.

The suffix array comes from distributed prefix doubling. Suffixes are ranked by their first line; in every round
the pair (own rank, rank of the suffix h lines on) ranks them by 2h lines, until no class of equal prefixes
splits any more. Ranks number the distinct pairs, dealt by ranges and sorted, so no task sees more than its
range. The suffixes of one rank after a round are the interval of the array whose longest common prefix
reaches 2h lines (or its members' ends): each but the first in the text is a later copy of that many lines, and the union of those stretches
is the union of the maximal repeated runs. Lines that occur once can't lie in a repeated run; they are dropped before the first round and bound
the sequences, which leaves a fraction of the lines. Lines and ids are compared by 128-bit hashes.

Only built-in functions are used; hot lines are counted before the shuffle and split by the adaptive join. Null text
counts as one without lines and stays null. Rows with one id and text are one document and get one result. Rows with a null id come first. In
a run that overlaps its own copy (a a a) all but the first place is a later copy. A text of which no line with a word is left becomes empty.
An empty table gives no rows. All other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .columns import free_names
from .storage import stored

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
AT = ["d", "t", "j"]  # id, hash of the text, line among those with a word


def _worded(text: Column) -> Column:
    """(place, line) of the lines with a word."""
    placed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(placed, lambda x: x["line"].rlike(WORD))


def _identity(docs: DataFrame, key: str, text: str) -> list[Column]:
    return [F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(docs[text]).alias("t")]


def lines_of(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(d, t, j, i, h1, h2, long): every line with a word, j among them, i among all lines; long: it has min_words words."""
    rows = docs.select(*_identity(docs, key, text), F.posexplode(_worded(docs[text])).alias("j", "x"))
    line = F.col("x")["line"]
    return rows.select(*AT, F.col("x")["i"].alias("i"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), line.rlike(f"(?:{WORD}+{SPACE}){{{min_words - 1}}}{WORD}").alias("long"))


ROUND = 1 << 54  # ranks of different rounds never meet: partition and row take less


def ranked(classes: DataFrame, keys: list[str], turn: int, name: str) -> DataFrame:
    """classes with their rank in the order of the keys: they are dealt by ranges and sorted, and a row's number within its
    range, behind the range's own, orders all of them. Stored, as another sampling of the ranges would number anew."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classes.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return stored(dealt.withColumn("rank", F.monotonically_increasing_id() + F.lit(turn * ROUND)), name)


def suffix_array(names: DataFrame, label: str = "suffixes") -> DataFrame:
    """names: (d, t, j, left, r, size, first), r the rank of the line, size and first its class, left the lines up to the
    sequence's end. Returns (d, t, j, ranks, copied): the ranks of the suffix by its first line, first two lines, and so on,
    and how many lines of it stand at an earlier place, resolved to powers of two and the sequence's end. Sorted by ranks, suffixes with
    equal prefixes lie side by side: that is the array, and the suffixes with an equal rank are its intervals.

    A suffix takes part in a round while its class has others and it has lines beyond the prefix compared so far, so rounds
    shrink with the repeated runs that are left. The driver sees one test for emptiness per round.
    """
    place = F.struct(*AT)
    current = names.withColumn("copied", F.when(place != F.col("first"), 1).otherwise(0)).withColumn("ranks", F.array("r"))
    columns = [*AT, "left", "r", "copied", "ranks"]
    settled, h, turn = None, 1, 1
    while True:
        current = stored(current.select(*columns, "size"), f"{label}-{turn}")
        going = (F.col("size") > 1) & (F.col("left") > h)
        ended = current.where(~going).select(*columns)
        settled = ended if settled is None else settled.unionByName(ended)
        active = current.where(going).select(*columns)
        if active.isEmpty():
            return settled.select(*AT, "ranks", "copied")
        ahead = settled.unionByName(active).select("d", "t", (F.col("j") - h).alias("j"), F.col("r").alias("r2"))
        paired = stored(active.join(ahead, AT, "left").withColumn("r2", F.coalesce("r2", F.lit(-1).cast("long"))), f"{label}-pairs")
        classes = paired.groupBy("r", "r2").agg(F.count("*").alias("size"), F.min(place).alias("first"))
        later = paired.join(ranked(classes, ["r", "r2"], turn, f"{label}-classes"), ["r", "r2"])
        copied = F.when(place != F.col("first"), F.least("left", F.lit(2 * h))).otherwise(F.col("copied")).alias("copied")
        current = later.select(*AT, "left", F.col("rank").alias("r"), copied, F.concat("ranks", F.array("rank")).alias("ranks"), "size")
        h, turn = 2 * h, turn + 1


def later_windows(starts: DataFrame, n: int) -> DataFrame:
    """(d, t, j): where n lines begin that also stand at an earlier place. starts: (d, t, j, left, ranks, copied).

    Of a power of two that is what doubling has found. For another n, with h the power of two below it, n lines are equal
    if their first h and their last h are, and those have ranks already: the intervals whose longest common prefix
    reaches n lines are the classes of such pairs. A suffix without a rank of h lines has none or is the only one."""
    turn = n.bit_length() - 1
    h = 1 << turn
    if n == h:
        return starts.where(F.col("copied") >= n).select(*AT)
    known = starts.where(F.size("ranks") > turn).select(*AT, "left", F.get("ranks", F.lit(turn)).alias("r"))
    ends = known.select("d", "t", (F.col("j") - (n - h)).alias("j"), F.col("r").alias("r2"))
    windows = stored(known.where(F.col("left") >= n).join(ends, AT).select(*AT, "r", "r2"), "windows")
    first = windows.groupBy("r", "r2").agg(F.min(F.struct(*AT)).alias("first"))
    return windows.join(first, ["r", "r2"]).where(F.struct(*AT) != F.col("first")).select(*AT)


def repeated_lines(docs: DataFrame, *, min_lines: int = 2, min_words: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, i): the lines to delete, i their places in the text, each once."""
    if min_lines < 1:
        raise ValueError("min_lines is at least 1")
    lines = lines_of(docs, key, text, max(1, min_words))
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("size"), F.min(F.struct(*AT)).alias("first")).where("size > 1")
    named = ranked(often, ["h1", "h2"], 0, "lines").withColumnRenamed("rank", "r")
    # rows that are there twice count as one here; their lines are compared with themselves, which deletes nothing
    seen = lines.join(named, ["h1", "h2"]).select(*AT, "i", "long", "r", "size", "first").distinct()
    # sequences end where a line occurs once: stretches of consecutive j
    own = W.partitionBy("d", "t").orderBy("j")
    seen = seen.withColumn("stretch", F.col("j") - F.row_number().over(own))
    seen = seen.withColumn("left", F.max("j").over(W.partitionBy("d", "t", "stretch")) - F.col("j") + 1).drop("stretch")
    seen = stored(seen, "repeated")
    found = suffix_array(seen.select(*AT, "left", "r", "size", "first"))
    starts = seen.drop("r", "size", "first").join(found, AT)
    windows = later_windows(starts, min_lines)
    runs = windows.select("d", "t", F.explode(F.sequence(F.col("j"), F.col("j") + min_lines - 1)).alias("j"))
    alone = starts.where("copied > 0 and long").select(*AT)
    return seen.join(runs.unionByName(alone).distinct(), AT, "left_semi").select("d", "t", "i")


def delete_repeats(docs: DataFrame, *, min_lines: int = 2, min_words: int = 8, key: str = "doc_id", text: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with later copies deleted from the text. counts: names for two more columns, the lines with a word and
    how many of them went."""
    lost, d_of, t_of = free_names(docs, "__gone", "__d", "__t")
    gone = repeated_lines(docs, min_lines=min_lines, min_words=min_words, key=key, text=text)
    listed = gone.groupBy("d", "t").agg(F.collect_list("i").alias(lost)).withColumnsRenamed({"d": d_of, "t": t_of})
    d, t = _identity(docs, key, text)
    joined = docs.join(listed, (d == F.col(d_of)) & (t == F.col(t_of)), "left")
    lines = F.split(docs[text], "\n")

    def without(x: Column) -> Column:
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: F.get(x, i))
        return F.transform(F.array(F.array_join(kept, "\n")), lambda s: F.when(s.rlike(WORD), s).otherwise(F.lit("")))[0]

    new = F.when(F.col(lost).isNull(), docs[text]).otherwise(F.transform(F.array(lines), without)[0])
    columns = [new.alias(c) if c == text else docs[c] for c in docs.columns]
    if counts:
        columns += [F.size(_worded(docs[text])).cast("long").alias(counts[0]), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*columns)


def without_repeats(docs: DataFrame, *, min_lines: int = 2, min_words: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without later copies and without the texts of which nothing is left by that; columns unchanged."""
    (before,) = free_names(docs, "__had_words")
    marked = docs.withColumn(before, F.coalesce(docs[text].rlike(WORD), F.lit(False)))
    out = delete_repeats(marked, min_lines=min_lines, min_words=min_words, key=key, text=text)
    return out.where(~(out[before] & (out[text] == ""))).drop(before)
