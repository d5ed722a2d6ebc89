"""Writers. Output is a folder per data set; nothing overwrites what it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.labels import model_short_name


def run_time(moment: Column | None = None) -> Column:
    """Time stamp of a run as text; pass the moment for repeatable output."""
    moment = F.current_timestamp() if moment is None else moment
    return F.date_format(moment, fixed.RUN_TIME_FORMAT)


def write_csv(
    df: DataFrame, path: str, partition_by: list[str] | None = None, delimiter: str = ",", mode: str = "overwrite"
) -> str:
    """CSV in the dialect of ``readers.read_csv``; blanks around a text are kept."""
    writer = (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def corpus_name(include_null: bool, include_synthetic: bool) -> str:
    return (
        "cleaned_data"
        + ("_with_null" if include_null else "")
        + ("_with_synth" if include_synthetic else "")
    )


def write_corpus(
    df: DataFrame, folder: str, include_null: bool, include_synthetic: bool, format: str = "csv"
) -> str:
    """Write a cleaned corpus under a name made from its flags."""
    path = f"{folder.rstrip('/')}/{corpus_name(include_null, include_synthetic)}.{format}"
    if format == "csv":
        return write_csv(df, path)
    if format != "parquet":
        raise TypeError(f"unknown format {format!r}")
    df.write.mode("overwrite").parquet(path)
    return path


def append_generated(
    df: DataFrame, folder: str, model: str, run_ts: str, replace_run: bool = False
) -> str:
    """Append records as JSON lines under model, class and run.

    Rows are rebalanced by class first: few files per class, and a large class
    is split over several. ``replace_run`` replaces what the same run wrote
    before, so a repeated run leaves no second copy.
    """
    writer = (
        df.withColumn("model", model_short_name(F.lit(model)))
        .withColumn("sdg_goal", F.col("sdg_id"))
        .withColumn("run_ts", F.lit(run_ts))
        .hint("rebalance", "sdg_goal")
        .write.mode("overwrite" if replace_run else "append")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "sdg_goal", "run_ts")
    )
    writer.json(folder)
    return folder


def write_per_topic(df: DataFrame, folder: str) -> str:
    """One sub-folder of CSV files per topic."""
    return write_csv(df.hint("rebalance", "topic"), folder, ["topic"])


def write_splits(df: DataFrame, folder: str) -> str:
    """One sub-folder of CSV files per split."""
    return write_csv(df, folder, ["split"])


def write_documents(df: DataFrame, path: str) -> str:
    """Nested records as JSON, one document per line."""
    df.write.mode("overwrite").json(path)
    return path
