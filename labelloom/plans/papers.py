"""Category analysis of papers: metadata joined with class labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import html
from labelloom.operators.categories import (
    distinct_lines,
    metadata_lines,
    papers_per_category,
    path_nodes,
)
from labelloom.operators.filters import only_keys
from labelloom.operators.lookup import first_match, unmatched
from labelloom.sources.staging import stage


def metadata_entries(
    pages: DataFrame, page_id: str = "id", column: str = "html",
    css_class: str = fixed.METADATA_BLOCK_CLASS,
) -> DataFrame:
    """(id, row number, key, value, closed) from the first metadata block of each landed page.

    Per table row the first header cell is the key and the first data cell the
    value. Rows lacking either have a null there, and rows with a table that never
    ends are not closed; see ``valid_entries``.
    """
    block = F.get(html.blocks(F.col(column), css_class), F.lit(0))
    # The cells are made before the rows are told apart, or a filter on them would make them again.
    entries = F.transform(
        block,
        lambda r: F.struct(
            F.get(html.header_cells(r), F.lit(0)).alias("key"), F.get(html.data_cells(r), F.lit(0)).alias("value"), r["closed"].alias("closed")
        ),
    )
    # Outer, because a filter on the block's size would be inferred and compute the block again.
    rows = pages.select(page_id, F.posexplode_outer(entries).alias("row_no", "row")).filter(F.col("row").isNotNull())
    return rows.select(page_id, F.col("row_no").cast("bigint").alias("row_no"), "row.key", "row.value", "row.closed")


def _valid() -> Column:
    return F.col("key").isNotNull() & F.col("value").isNotNull() & F.col("closed")


def valid_entries(entries: DataFrame, page_id: str = "id") -> DataFrame:
    """One value per key and page; of a repeated key the last one."""
    return (
        entries.filter(_valid())
        .groupBy(page_id, "key")
        .agg(F.max_by("value", "row_no").alias("value"))
    )


def rejected_entries(entries: DataFrame) -> DataFrame:
    """Rows without a key or a value, and rows that are not closed."""
    return entries.filter(~_valid())


def label_papers(
    metadata: DataFrame, labels: DataFrame, label: str = "SDG"
) -> tuple[DataFrame, DataFrame]:
    """(papers with the class of their first label row, papers without one)."""
    listed = labels.select(F.col("ID").alias("id"), label, "row_no")
    return (
        first_match(metadata, listed, "id", ["row_no"], [label]),
        unmatched(metadata, listed, "id"),
    )


def category_tree(papers: DataFrame, label: str = "SDG") -> DataFrame:
    """Nodes of each class's category tree, from both category keys."""
    lines = only_keys(distinct_lines(metadata_lines(papers, [label]), label))
    return path_nodes(lines.select(label, F.col("line").alias("path")), label)


def faculty_counts(papers: DataFrame, label: str = "SDG", mode: str = "all") -> DataFrame:
    """Papers per class and top-level community."""
    listed = papers.withColumn("_paths", F.try_element_at("meta", F.lit(fixed.CATEGORY_KEYS[0])))
    return papers_per_category(listed, label, "_paths", mode)


def tree_documents(nodes: DataFrame, label: str) -> DataFrame:
    """One JSON text per class holding its tree as nested objects.

    Built level by level from the leaves, each level one aggregation by
    parent; the rows are distinct categories, not papers. The nodes are staged
    once, and their greatest depth gives the number of levels. The document of
    a class is one row, as it is one document.
    """
    nodes = stage(nodes.select(label, "path", "depth"), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    inner = nodes.filter(F.col("depth") == deepest).select(label, "path", F.lit("{}").alias("json"))
    for depth in range(deepest, 0, -1):
        # A one-element JSON array without its brackets is the quoted name.
        listed = F.to_json(F.array(F.element_at("path", -1)))
        name = F.substr(listed, F.lit(2), F.length(listed) - 2)
        member = F.concat(name, F.lit(":"), F.col("json"))
        parent = F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path")
        members = F.array_join(F.array_sort(F.collect_list(member)), ",")
        grouped = inner.groupBy(label, parent).agg(
            F.concat(F.lit("{"), members, F.lit("}")).alias("json")
        )
        if depth > 1:
            level = nodes.filter(F.col("depth") == depth - 1).select(label, "path")
            inner = level.join(grouped, [label, "path"], "left").select(
                label, "path", F.coalesce("json", F.lit("{}")).alias("json")
            )
    return grouped.select(label, F.col("json").alias("tree"))
