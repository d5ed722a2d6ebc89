"""Targets and indicators of each goal from landed wiki pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import html
from labelloom.operators.batching import nested_lists
from labelloom.operators.targets import fill_targets, indicators, rejected_rows
from labelloom.sources.staging import stage


def all_table_rows(
    pages: DataFrame, page_id: str = "page_id", column: str = "html",
    css_class: str = fixed.TARGET_TABLE_CLASS,
) -> DataFrame:
    """(page, goal, row_no, cells, closed): the n-th table of a page is goal n.

    Row numbers count from 1 in document order; row 1 is the table's header
    and is left out. A row with an inner table that never ends is not closed.
    """
    # Outer, because a filter on the blocks' number would be inferred and compute the blocks again.
    tables = pages.select(
        page_id, F.posexplode_outer(html.blocks(F.col(column), css_class)).alias("_table", "rows")
    )
    rows = tables.select(
        page_id, (F.col("_table") + 1).alias("goal"), F.posexplode("rows").alias("_row", "row")
    )
    return rows.filter(F.col("_row") > 0).select(
        page_id, "goal", (F.col("_row") + 1).alias("row_no"),
        html.data_cells(F.col("row")).alias("cells"), F.col("row.closed").alias("closed"),
    )


def table_rows(
    pages: DataFrame, page_id: str = "page_id", column: str = "html",
    css_class: str = fixed.TARGET_TABLE_CLASS,
) -> DataFrame:
    """(page, goal, row_no, cells) of the rows that are closed."""
    return all_table_rows(pages, page_id, column, css_class).filter("closed").drop("closed")


def open_rows(
    pages: DataFrame, page_id: str = "page_id", column: str = "html",
    css_class: str = fixed.TARGET_TABLE_CLASS,
) -> DataFrame:
    """(page, goal, row_no, cells) of the rejected rows, those that are not closed."""
    return all_table_rows(pages, page_id, column, css_class).filter("not closed").drop("closed")


def goal_targets(rows: DataFrame, page_id: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(indicators per page, goal and target, rejected rows).

    Table rows come from whole pages, so they are staged before they are used more
    than once, and the filled rows as well.
    """
    filled = stage(fill_targets(stage(rows, "table-rows"), [page_id, "goal"]), "filled-rows")
    return indicators(filled, [page_id, "goal"]), rejected_rows(filled)


def target_documents(valid: DataFrame) -> DataFrame:
    """Ordered indicator lists per table and target, for the JSON sink."""
    group = [c for c in valid.columns if c not in ("row_no", "run", "indicator")]
    return nested_lists(valid, group, ["row_no"], "indicator", "indicators")
