"""Null-class corpus from landed search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import array_to_text
from labelloom.operators.dedup import distinct_rows
from labelloom.operators.filters import drop_missing
from labelloom.operators.sampling import top_per_group


def topic_rows(hits: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows per topic from landed hits; hits without an abstract are skipped.

    All hits count; a ``cap`` keeps that many per topic, by rank.
    """
    if cap is not None:
        hits = top_per_group(hits, "topic", ["rank", "paperId"], cap)
    return drop_missing(hits, "abstract").select(
        "topic",
        F.col("paperId").alias("id"),
        "title",
        "abstract",
        array_to_text(F.col("fieldsOfStudy")).alias("field"),
        F.lit(0).alias("sdg_relation"),
    )


def null_class(rows: DataFrame) -> DataFrame:
    """Labelled class 0, whole-row duplicates removed before the write."""
    columns = ("id", "title", "abstract", "field", "sdg_relation")
    return distinct_rows(rows.select(*columns).withColumn("sdg_label", F.lit(0)))
