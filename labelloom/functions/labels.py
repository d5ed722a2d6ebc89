"""Small fixed look-ups as map expressions: no join and no shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import fixed


def map_literal(mapping: Mapping) -> Column:
    return F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair])


def _class_name(label: Column, names: tuple[str, ...]) -> Column:
    number = label.cast("string").try_cast("int")
    return (
        F.when(number.isNull(), label.cast("string"))
        .when(
            number.between(0, len(names) - 1),
            F.element_at(F.array(*[F.lit(n) for n in names]), number + 1),
        )
        .otherwise(
            F.raise_error(F.concat(F.lit("unknown class: "), label.cast("string")))
        )
    )


def label_word(label: Column) -> Column:
    """Class number as a word; other text passes through, unknown numbers raise."""
    return _class_name(label, fixed.NUMBER_WORDS)


def goal_name(label: Column) -> Column:
    return _class_name(label, fixed.GOAL_NAMES)


def model_short_name(
    model: Column, names: Mapping[str, str] = fixed.MODEL_SHORT_NAMES
) -> Column:
    """Short name of a model, or the given name where none is listed."""
    return F.coalesce(F.try_element_at(map_literal(names), model), model)


def arg_max(scores: Column) -> Column:
    """Position of the first largest score, counted from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("bigint")
