"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing a table there and reading it back: after an executor
is lost, later stages read the files again instead of recomputing what came
before, and values that must not change between two readers (task-local
counters, iteration states) are fixed once written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from versekit.session import ensure_checkpoint_dir


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder; return the table read back and its path.

    The shuffle files of the write are deleted when it has ended (a public SQL
    setting, restored afterwards): nothing reads them again once the table is there.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
