"""The registered queries of this subpackage, each an operator over its whole table with production parameters, and
the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, language, line_runs, lm, near_vectors, packing, parity_join, personal, quality, ranked_search, warc, wavelet
from .storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_BITS = "(unhex(sha1(coalesce(html, ''))))::bit::varchar"
_BASE32 = f"array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(1, 6), lambda k: cast(substr({_BITS}, i + k, 1) as int) * (1 << (5 - k)))) as bigint), 1)), '')"


@query(
    "op1_warc",
    """with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as s, html from pages),
f as (select *, min(page_id) over (partition by s) as first_id from p)
select page_id, cast(payload_bytes as bigint) as payload_bytes, """
    + _BASE32
    + """ as payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
case when page_id <> first_id then first_id end as refers_to from f""",
)
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archives written, normalised and read back by their index."""
    archives = warc.archive(table(spark, folder, "pages"), least_bytes=0)
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_wavelet")
def op2_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    """Token shards written in key order and read back."""
    return wavelet.read_rows(wavelet.write_shards(table(spark, folder, "documents")))


@query(
    "op3_line_runs",
    r"""with l as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) as i from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null)),
w as (select *, row_number() over (partition by doc_id order by i) as j, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as words
from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (select *, lead(line) over (partition by doc_id order by j) as nxt from w),
c as (select *, row_number() over (partition by line order by doc_id, j) as one, case when nxt is not null then row_number() over (partition by line, nxt order by doc_id, j) end as two from n),
g as (select *, (one > 1 and words >= 8) or coalesce(two > 1, false) or coalesce(lag(two) over (partition by doc_id order by j) > 1, false) as gone from c),
k as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed from g group by doc_id),
t as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) as text from l left join g on l.doc_id = g.doc_id and l.i = g.i where not coalesce(g.gone, false) group by l.doc_id)
select d.doc_id, case when coalesce(k.n_removed, 0) = 0 then d.text when k.n_removed = k.n_lines then '' else t.text end as text,
coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed from documents d left join k using (doc_id) left join t using (doc_id)""",
)
def op3_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without later copies of repeated line runs."""
    found = line_runs.delete_repeats(table(spark, folder, "documents"), counts=("n_lines", "n_removed"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


@query(
    "op4_parity_join",
    r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a from documents),
s as (select doc_id, unnest(case when len(a) = 0 then [] when len(a) < 3 then [array_to_string(a, ' ')]
else list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) end) as g from w),
c as (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as n from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select i.a, i.b from i join c p on i.a = p.doc_id join c q on i.b = q.doc_id where 100 * i.n >= 90 * (p.n + q.n - i.n)),
r as (select doc_id, doc_id as reached from documents union select r.doc_id, e.b from r join e on r.reached = e.a),
m as (select doc_id, min(reached) as component_id from r group by doc_id)
select m.doc_id, coalesce(c.n, 0) as n_shingles, m.component_id from m left join c using (doc_id)""",
)
def op4_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the 3-word shingle join at a Jaccard similarity of 0.9."""
    found = parity_join.classes(table(spark, folder, "documents"), k=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of ids and decoded texts."""
    return bpe.token_digests(table(spark, folder, "documents"))


@query("op6_packing")
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Places of all token pieces in sequences of 1024."""
    return packing.pack(stored(packing.token_pieces(table(spark, folder, "documents")), "pieces"))


@query("op7_language")
def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted languages; learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(docs["doc_id"].cast("string")) % 4 == 2
    model = language.train(docs, ~held_out)
    found = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return found


@query("op8_lm")
def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all texts under a model of the texts that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(docs["doc_id"].cast("string")) % 7 == 2
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return lm.train_and_score(marked, ~marked["held_out"], keep=["doc_id", "held_out"])


@query("op9_near_vectors")
def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links of vectors with one label at a cosine of 0.98, and their components."""
    found = near_vectors.links(table(spark, folder, "embeddings"), least=0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


@query(
    "op10_quality",
    r"""with w as (select doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as a,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
g as (select doc_id, i, array_to_string(a[i:i + 4], ' ') as r from (select doc_id, a, unnest(range(1, len(a) - 3)) as i from w)),
d as (select doc_id, i, count(*) over (partition by doc_id, r) as n from g),
p as (select doc_id, count(distinct i + k) as n_repeat_words from (select doc_id, i, unnest(range(0, 5)) as k from d where n > 1) group by doc_id),
m as (select w.doc_id, cast(len(a) as bigint) as n_words, cast(length(array_to_string(a, '')) as bigint) as word_chars,
cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, len(l) as lines,
coalesce(p.n_repeat_words, 0) as n_repeat_words from w left join p using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 40 * lines
or (n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words))) as kept from m""",
)
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The cascade's verdict beside the measures of every text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.cascade(docs, reason="rejected_by")
    text = F.col("text")
    measured = judged.select("doc_id", quality.n_words(text).alias("n_words"), quality.word_chars(text).alias("word_chars"), quality.n_symbols(text).alias("n_symbols"), quality.n_dup_lines(text).alias("n_dup_lines"), quality.n_repeat_words(text).alias("n_repeat_words"), F.col("rejected_by").isNull().alias("passed"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("passed")).drop("passed")


@query("op11_personal")
def op11_personal(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all texts, by rules and by the field trained on them."""
    docs = table(spark, folder, "documents")
    return personal.scan(docs, personal.train(docs))


@query(
    "op12_collocations",
    r"""with p as (select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as a from (select coalesce(lang, 'und') as lang,
unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents)),
f as (select lang, w, cast(count(*) as bigint) as f from (select lang, unnest(list_transform(range(1, len(a) + 1), lambda i: a[i:i])) as w from p
union all select lang, unnest(list_transform(range(1, len(a)), lambda i: a[i:i + 1])) from p
union all select lang, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i:i + 2])) from p) group by lang, w),
t as (select lang, cast(sum(f) as bigint) as n from f where len(w) = 1 group by lang),
c as (select lang, w, f as a from f where len(w) > 1 and f >= 10),
o as (select lang, w, max(a) as outer_a from (select lang, w[1:2] as w, a from c where len(w) = 3 union all select lang, w[2:3], a from c where len(w) = 3) group by lang, w),
k as (select c.lang, c.w, c.a, unnest(range(1, len(c.w))) as k from c left join o on c.lang = o.lang and c.w = o.w where o.outer_a is null or 100 * o.outer_a < 50 * c.a),
s as (select k.lang, k.w, k.a, k.k, l.f as l, r.f as r, cast((cast(1000000 as hugeint) * k.a * k.a) // (cast(l.f as hugeint) * r.f) as bigint) as score
from k join f l on l.lang = k.lang and l.w = k.w[1:k.k] join f r on r.lang = k.lang and r.w = k.w[k.k + 1:len(k.w)]),
b as (select *, row_number() over (partition by lang, w order by score, k) as cut from s),
z as (select lang, array_to_string(w, ' ') as phrase, a, l, r, score from b where cut = 1),
y as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from z)
select y.lang, rank, phrase, a, l, r, n, score from y join t on y.lang = t.lang where rank <= 2000""",
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, folder, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_ranked_search",
    f"""with d as (select doc_id, a, len(a) as n from (select doc_id, {_TERMS} as a from documents where text is not null) where len(a) > 0),
c as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(a) as term from d) group by all),
w as (select term, cast(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term),
q as (select distinct item_id, term from (select item_id, unnest({_TERMS}) as term from benchmark where text is not null)),
s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) as bigint) as score
from q join p using (term) join w using (term), c group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 50""",
)
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)
