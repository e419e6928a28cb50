"""Settled intermediate results: written once to the cluster's shared checkpoint folder, so that lost
executors cost a re-read and not a re-computation with other block numbers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a session on one machine may go without it and
    gets a new temporary one."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"name a shared folder in {SETTING}")
    return tempfile.mkdtemp(prefix="tapeframe-")


def settle(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody has used, for tables a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/run-{os.urandom(8).hex()}/{name}"
