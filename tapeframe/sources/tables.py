"""Readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, *, fallback: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Parquet at `path`; where there is none, the first (format, path) of `fallback` that exists."""
    for fmt, where in [("parquet", path), *fallback]:
        reader = spark.read.format(fmt)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            return reader.load(where)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(path)


def with_file_order(df: DataFrame, name: str = "seq", *, file: str | None = None) -> DataFrame:
    """Position of the row in its file, the tie-break for events with equal stamps, and on request the file. Call it directly
    on a scan of files that keep an episode in one file."""
    df = df.withColumn(name, F.col("_metadata.row_index"))
    return df.withColumn(file, F.col("_metadata.file_path")) if file else df


def read_periods(spark: SparkSession, paths: Sequence[str], *, base: str | None = None) -> DataFrame:
    """Per-period files (patterns too) as one scan, columns by name; columns a file lacks are null. With `base`, the period comes from the names of
    the folders below it, and a filter on it leaves whole folders out."""
    reader = spark.read.option("mergeSchema", True)
    return (reader.option("basePath", base) if base else reader).parquet(*paths)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Episode ids from a CSV with a header; other columns are not parsed."""
    header = spark.read.option("header", True).csv(path)
    return header.select(F.col("sample_id").cast("long"))


def write_periods(df: DataFrame, path: str, period: str = "month") -> None:
    """One directory per period. A re-run replaces the periods it holds and leaves the others. The
    rebalance hint lets adaptive execution split a large period over as many files as its size asks for."""
    (
        df.hint("rebalance", period)
        .sortWithinPartitions(period, "sample_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(period)
        .parquet(path)
    )


def write_events(df: DataFrame, path: str, periods: DataFrame, *, key: str = "sample_id", order: str = "seq") -> None:
    """Events in one folder per period, with the column `order` that keeps their place. `periods` is (key, month); events of other
    episodes are left out. Ranges of (month, key) go to one task each, so an episode stays in one file, and a file is sorted by
    (key, order)."""
    (
        df.join(periods.select(key, "month"), key)
        .repartitionByRange("month", key)
        .sortWithinPartitions("month", key, order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", 0)
        .partitionBy("month")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str, schema: T.StructType, periods: Sequence[int] | None = None, *, order: str = "seq") -> DataFrame | None:
    """What `write_events` wrote, None where it wrote nothing; folders of other periods are not listed in the scan."""
    stored = T.StructType([*schema.fields, T.StructField(order, T.LongType()), T.StructField("month", T.IntegerType())])
    try:
        df = read_table(spark, path, stored)
    except FileNotFoundError:
        return None
    return df if periods is None else df.where(F.col("month").isin(list(periods)))


def convert(df: DataFrame, path: str) -> None:
    """zstd parquet rewrite that leaves an existing target alone."""
    df.write.mode("ignore").option("compression", "zstd").parquet(path)


def write_predictions(df: DataFrame, path: str, value: str = "prediction") -> None:
    df.select("sample_id", value).write.mode("overwrite").parquet(path)


def write_oof(df: DataFrame, path: str) -> None:
    """(arm, fold, sample_id, pred), one directory per arm and fold."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("arm", "fold")
        .parquet(path)
    )


def read_oof(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, pred): the combined table folder/oof_all.parquet where there is one, else the
    union of the fold files folder/f*.parquet."""
    for path in (f"{folder}/oof_all.parquet", f"{folder}/f*.parquet"):
        try:
            return spark.read.parquet(path).select("sample_id", "pred")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(folder)
