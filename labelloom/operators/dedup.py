"""Duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.hashing import content_key


def distinct_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates removed; two nulls are equal.

    Copies collapse inside each input partition before anything is shuffled.
    """
    return df.distinct()


def distinct_on(df: DataFrame, columns: Sequence[str], row_id: str) -> DataFrame:
    """Keep the row with the smallest id among rows equal in ``columns``.

    The aggregation sees a fixed-size key and the id only (pre-aggregated per
    partition, so a group of copies is no hot spot). The texts are moved once,
    by unique row id.
    """
    key = content_key(*[F.col(c) for c in columns])
    survivors = (
        df.select(key.alias("_content"), row_id)
        .groupBy("_content")
        .agg(F.min(row_id).alias(row_id))
        .select(row_id)
    )
    return df.join(survivors, row_id, "left_semi")
