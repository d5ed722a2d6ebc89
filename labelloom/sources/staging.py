"""Staged tables: small or expensive intermediate results kept in shared storage.

A staged table cuts the lineage (lost executors re-read it instead of
recomputing) and has a size the planner can read from its files. Joins with it
therefore become broadcast joins only while it really is below
``spark.sql.autoBroadcastJoinThreshold``, and shuffle joins beyond that.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Whether the shuffle files of a query go as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a folder below the user's home on the session's default
    Hadoop file system, which all executors reach. A default file system of one machine
    will do for a local session only; on a cluster it is refused.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(hadoop)
    if files.getUri().getScheme() == "file" and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"staged tables need a folder that all executors reach: set {CHECKPOINT_DIR}")
    return f"{files.getHomeDirectory().toString().rstrip('/')}/.labelloom"


def new_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return f"{shared_dir(spark)}/labelloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and return the frame that reads it back.

    The shuffle files of the write go when it has ended: the staged files stand for them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
