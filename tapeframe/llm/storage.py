"""Tables and files that a job leaves in the shared folder for its later steps.

Tables go through Spark. Binary files (archives, token shards, graphs) are written by tasks with pyarrow's
file systems under a name no other attempt uses; the names travel in a table that Spark commits, so a task
that ran twice leaves an unused file and never a torn one.
"""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tapeframe.sources.shared import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written once to the shared folder; reading it again never computes df again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_uri(spark: SparkSession, name: str) -> str:
    """A folder for a job's binary files, as an address that every task can open."""
    path = scratch_path(spark, name)
    return path if ":/" in path else f"file://{os.path.abspath(path)}"


def write_file(folder: str, name: str, data: bytes) -> str:
    """Writes one file under a name of its own and returns its address."""
    uri = f"{folder}/{name}-{os.urandom(8).hex()}"
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


def read_file(uri: str) -> bytes:
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_stream(path, compression=None) as src:
        return src.read()


def open_file(uri: str):
    """A file that can be read at any place."""
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)
