"""Array functions whose element function is SQL text.

The lambda is parsed inside the JVM, so a word list of any length costs one
call instead of one call per word; the optimizer turns ``in`` lists into hash
sets.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literals(values: Iterable[str]) -> str:
    return ", ".join(literal(v) for v in values)


def filter_items(array: Column, condition: str) -> Column:
    """Elements ``w`` for which the SQL condition holds."""
    return F.call_function("filter", array, F.expr(f"w -> {condition}"))


def map_items(array: Column, expression: str) -> Column:
    """The SQL expression of every element ``w``."""
    return F.call_function("transform", array, F.expr(f"w -> {expression}"))


def map_value(value: Column, expression: str) -> Column:
    """The SQL expression of one value ``w``, which is computed once however often it is named."""
    return F.get(map_items(F.array(value), expression), F.lit(0))
