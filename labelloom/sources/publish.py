"""Versioned folders: a data set is rewritten under its own name without harm to its readers.

Every publication writes a new version folder and then swaps a one-line manifest that
names it. The swap is a rename over the old manifest, one step of the file system:
readers see the old version or the new one, never a mixture, and a run that fails before
the swap changes nothing. A plan reads the manifest once, so it stays with one version
even while another is published, which is what lets a data set be read, mapped and
published again in one job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "CURRENT"


def _files(spark: SparkSession, folder: str):
    """The Hadoop file context of a folder, and a function from names to its paths."""
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        jvm.org.apache.hadoop.fs.Path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    ) if "://" in folder or folder.startswith("file:") else jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        spark.sparkContext._jsc.hadoopConfiguration()
    )
    return context, lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version the manifest names, or None before the first publication."""
    context, path = _files(spark, folder)
    if not context.util().exists(path(MANIFEST)):
        return None
    stream = context.open(path(MANIFEST))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def current_path(spark: SparkSession, folder: str) -> str:
    """The folder of the current version; resolve it once per plan."""
    version = current_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return f"{folder.rstrip('/')}/{version}"


def _swap(spark: SparkSession, folder: str, version: str) -> None:
    context, path = _files(spark, folder)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    new = path(f"{MANIFEST}.{version}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$CreateOpts"), 0)
    stream = context.create(new, flags, no_options)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context.rename(new, path(MANIFEST), over)


def publish(df: DataFrame, folder: str, write: Callable[[DataFrame, str], object] | None = None) -> str:
    """Write a frame as the next version of a folder and make it the current one; returns its path.

    ``write`` gets the frame and the path of the new version; Parquet by default. Earlier
    versions stay for those who still read them.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    path = f"{folder.rstrip('/')}/{version}"
    if write is None:
        df.write.mode("errorifexists").parquet(path)
    else:
        write(df, path)
    _swap(spark, folder, version)
    return path


def rewrite(
    spark: SparkSession,
    folder: str,
    change: Callable[[DataFrame], DataFrame],
    read: Callable[[SparkSession, str], DataFrame] | None = None,
    write: Callable[[DataFrame, str], object] | None = None,
) -> str:
    """Read the current version, change it and publish the result under the same name."""
    path = current_path(spark, folder)
    return publish(change(spark.read.parquet(path) if read is None else read(spark, path)), folder, write)
