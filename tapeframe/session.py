"""Session settings the plans count on. Sizes are per task and do not depend on the amount of data."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # partitions are merged or split at run time to about this size, so a task fits in memory at any scale
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # joins of event rows with one row per episode: the hot side is split
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.compression.codec": "zstd",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def builder(app: str, **more: str) -> SparkSession.Builder:
    """A session builder with these settings; the cluster names spark.checkpoint.dir and the number of
    shuffle partitions (a few per core)."""
    b = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **more}.items():
        b = b.config(k, v)
    return b
