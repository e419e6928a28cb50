"""The corpus pipeline: documents in, token sequences out.

Quality rules, language identification, line deduplication, near-duplicate removal and packing, each over all rows
that the stage before kept. A stage's result is written to the shared folder and read again as the next one's
documents, so a lost executor costs the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import language, line_runs, packing, parity_join, quality
from tapeframe.llm.columns import free_names
from tapeframe.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.kept_only(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; it is fitted on a bounded sample of their labels."""
    model = language.train(docs, F.lit(True))
    names = tuple(free_names(docs, "__lang_pred", "__lang_score", "__lang_accepted"))
    return language.predict(docs, model, names=names).where(names[2]).drop(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go."""
    out = line_runs.without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingle sets that links of a Jaccard similarity of 0.8 or more connect."""
    return parity_join.one_of_each(docs, k=5, num=80, den=100)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 1024."""
    return packing.pack(stored(packing.token_pieces(docs), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("sequences", sequences),
]

# Language identification and packing are not expressible in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
