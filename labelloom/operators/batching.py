"""Fixed-size batches and nested lists of bounded length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.operators.ranking import ordered_position


def batch_number(position: Column, size: int = fixed.BATCH_SIZE) -> Column:
    """Batch (from 0) of a position counted from 1."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    return F.floor((position - 1) / size).cast("bigint")


def number_batches(
    df: DataFrame, group: Sequence[str], order: Sequence[str], size: int = fixed.BATCH_SIZE
) -> DataFrame:
    """Consecutive slices of each group in the given order; the last may be short."""
    numbered = ordered_position(df, group, order, "_position")
    return numbered.withColumn("batch_id", batch_number(F.col("_position"), size)).drop(
        "_position"
    )


def collect_batches(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "items"
) -> DataFrame:
    """One row per batch with its values in order; at most a batch's size each."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return df.groupBy(*group, "batch_id").agg(
        F.transform(packed, lambda item: item["_value"]).alias(name)
    )


def nested_lists(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    name: str = "items",
    part_size: int = 10_000,
) -> DataFrame:
    """Ordered lists per group in parts of bounded length (column ``batch_id``).

    Most groups have one part; a huge group has many instead of one huge row.
    """
    numbered = number_batches(df, group, order, part_size)
    return collect_batches(numbered, group, order, value, name)
