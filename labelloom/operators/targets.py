"""Row-spanned tables: forward fill and ordered lists.

A goal's table may be far larger than one task can sort, so runs over row
numbers are two-level: inside chunks of consecutive row numbers, then across
the chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import strip_blanks

CHUNK = 100_000


def _names(group: str | Sequence[str]) -> list[str]:
    return [group] if isinstance(group, str) else list(group)


def forward_fill(
    df: DataFrame, group: str | Sequence[str], row_no: str, values: dict[str, Column], chunk: int = CHUNK
) -> DataFrame:
    """Add each value's last non-null entry up to the row, in row order per group.

    A group is one column or several.

    ``row_no`` is an integer that is unique in its group, so a chunk has at
    most ``chunk`` rows whatever the group's size.
    """
    # A struct is never null, so plain equality serves a null group too, and
    # window and join share one shuffle.
    place = ["_group", "_chunk"]
    own = {name: f"_own_{name}" for name in values}
    chunked = df.select(
        *df.columns,
        F.struct(*_names(group)).alias("_group"),
        F.floor(F.col(row_no) / chunk).alias("_chunk"),
        *[value.alias(own[name]) for name, value in values.items()],
    )
    inside = Window.partitionBy(*place).orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    filled = chunked.select(
        *df.columns,
        *place,
        *[F.last(own[n], ignorenulls=True).over(inside).alias(f"_in_{n}") for n in values],
    )
    # max_by ignores rows whose ordering is null, so only filled rows compete.
    ends = chunked.groupBy(*place).agg(
        *[
            F.max_by(own[n], F.when(F.col(own[n]).isNotNull(), F.col(row_no))).alias(f"_end_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = ends.select(
        *place,
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_carry_{n}") for n in values],
    )
    return filled.join(carried, place).select(
        *df.columns, *[F.coalesce(f"_in_{n}", f"_carry_{n}").alias(n) for n in values]
    )


def fill_targets(
    rows: DataFrame, goal: str | Sequence[str] = "goal", row_no: str = "row_no", cells: str = "cells",
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows of spanned tables as (goal, row_no, target, run, indicator).

    ``goal`` names the column, or the columns such as page and goal, that tell
    one table from another.

    A row of three cells starts a target, a row of two continues it; other
    shapes are ignored. ``run`` is the row number at which the target started.
    A continuation before any target has null target and run.
    """
    names = _names(goal)
    size = F.size(cells)
    starts = size == 3
    shaped = rows.filter(size.isin(2, 3)).select(
        *names,
        row_no,
        F.when(starts, strip_blanks(F.get(cells, F.lit(0)))).alias("_target"),
        F.when(starts, F.col(row_no)).alias("_run"),
        strip_blanks(F.when(starts, F.get(cells, F.lit(1))).otherwise(F.get(cells, F.lit(0)))).alias(
            "indicator"
        ),
    )
    filled = forward_fill(
        shaped, names, row_no, {"target": F.col("_target"), "run": F.col("_run")}, chunk
    )
    return filled.select(*names, row_no, "target", "run", "indicator")


def rejected_rows(filled: DataFrame) -> DataFrame:
    """Continuation rows that precede every target of their goal."""
    return filled.filter(F.col("run").isNull())


def indicators(filled: DataFrame, goal: str | Sequence[str] = "goal") -> DataFrame:
    """The valid rows of each target; a repeated target keeps its last run only."""
    valid = filled.filter(F.col("run").isNotNull())
    keys = [*_names(goal), "target"]
    last = valid.groupBy(F.struct(*keys).alias("_of")).agg(F.max("run").alias("_run"))
    # A struct is never null, so a null target or group is found again.
    marked = valid.withColumn("_of", F.struct(*keys)).withColumn("_run", F.col("run"))
    return marked.join(last, ["_of", "_run"], "left_semi").select(*valid.columns)
