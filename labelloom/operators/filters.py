"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.text import contains_any


def only_language(df: DataFrame, language: str = "en", column: str = "language") -> DataFrame:
    return df.filter(F.col(column) == language)


def drop_missing(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def min_agreement(
    df: DataFrame, threshold: float | None = fixed.MIN_AGREEMENT, column: str = "agreement"
) -> DataFrame:
    """Keep rows whose agreement reaches the threshold; ``None`` keeps all rows."""
    return df if threshold is None else df.filter(F.col(column) >= threshold)


def exclude_class(df: DataFrame, excluded: int = 0, column: str = "label") -> DataFrame:
    """Drop one class; rows without a label stay."""
    return df.filter(~F.col(column).eqNullSafe(excluded))


def only_provenance(
    df: DataFrame, provenance: int = fixed.IS_ABSTRACT, column: str = "is_abstract"
) -> DataFrame:
    return df.filter(F.col(column) == provenance)


def drop_refusals(
    df: DataFrame, column: str = "message", markers: Sequence[str] = fixed.REFUSAL_MARKERS
) -> DataFrame:
    """Drop raw model messages that hold a refusal marker (case-sensitive)."""
    return df.filter(~contains_any(F.col(column), markers))


def only_keys(
    df: DataFrame, keys: Sequence[str] = fixed.CATEGORY_KEYS, column: str = "key"
) -> DataFrame:
    return df.filter(F.col(column).isin(list(keys)))
