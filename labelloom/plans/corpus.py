"""Corpus preparation: labelled sources in, one cleaned corpus out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.language import detect_language
from labelloom.functions.text import clean_synthetic_text, marker_flag, process_text
from labelloom.operators.filters import drop_missing, exclude_class, min_agreement
from labelloom.operators.lookup import union_all

PREPARED = ("text", "label", "is_abstract")


def from_abstracts(df: DataFrame) -> DataFrame:
    return (
        df.withColumnsRenamed({"ABSTRACT": "text", "SDG": "label"})
        .withColumn("is_abstract", F.lit(fixed.IS_ABSTRACT))
        .select(*PREPARED)
    )


def from_community(df: DataFrame, threshold: float | None = fixed.MIN_AGREEMENT) -> DataFrame:
    """Community texts; one that calls itself an abstract is flagged as such.

    ``threshold=None`` switches the agreement filter off.
    """
    return (
        min_agreement(df, threshold)
        .withColumnRenamed("sdg", "label")
        .withColumn("is_abstract", marker_flag(F.col("text")))
        .select(*PREPARED)
    )


def from_null_class(df: DataFrame) -> DataFrame:
    return (
        drop_missing(df, "abstract")
        .withColumnsRenamed({"abstract": "text", "sdg_label": "label"})
        .withColumn("is_abstract", F.lit(fixed.IS_ABSTRACT))
        .select(*PREPARED)
    )


def from_synthetic(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("text", clean_synthetic_text(F.col("text")))
        .withColumnRenamed("sdg_id", "label")
        .withColumn("is_abstract", F.lit(fixed.IS_SYNTHETIC))
        .select(*PREPARED)
    )


def harmonise(
    abstracts: DataFrame,
    community: DataFrame,
    null_class: DataFrame | None = None,
    synthetic: DataFrame | None = None,
    threshold: float | None = fixed.MIN_AGREEMENT,
    language: str = "en",
    detect: Callable[[Column], Column] = detect_language,
) -> DataFrame:
    """One frame (text, label, is_abstract) of all sources.

    The language is detected once over the union of the checked sources, row
    by row and without a shuffle. Synthetic texts are not checked. Without a
    null-class source, class 0 is removed from the other two.
    """
    checked = union_all(from_abstracts(abstracts), from_community(community, threshold))
    if null_class is None:
        checked = exclude_class(checked)
    else:
        checked = union_all(checked, from_null_class(null_class))
    kept = checked.filter(detect(F.col("text")) == language)
    return kept if synthetic is None else union_all(kept, from_synthetic(synthetic))


def clean(df: DataFrame) -> DataFrame:
    """(text_clean, label, is_abstract)."""
    return df.select(process_text(F.col("text")).alias("text_clean"), "label", "is_abstract")


def prepare_corpus(*sources: DataFrame | None, **options) -> DataFrame:
    """``harmonise`` and ``clean`` in one plan: scan, filter and project only."""
    return clean(harmonise(*sources, **options))
