"""Category paths: lines per class and key, counted parents, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.text import split_lines, split_path


def metadata_lines(
    papers: DataFrame, keep: list[str], meta: str = "meta"
) -> DataFrame:
    """One row per paper, metadata key and line of the value (a long table)."""
    entries = papers.select(*keep, F.explode(meta).alias("key", "value"))
    return entries.select(*keep, "key", F.explode(split_lines(F.col("value"))).alias("line"))


def distinct_lines(lines: DataFrame, label: str = "label") -> DataFrame:
    return lines.select(label, "key", "line").distinct()


def papers_per_category(
    papers: DataFrame,
    label: str,
    categories: str,
    mode: str = "all",
    separator: str = fixed.PATH_SEPARATOR,
) -> DataFrame:
    """Papers per (class, top category).

    ``categories`` holds one category path per line. ``all`` counts every
    distinct parent of a paper once, ``first`` only the parent of its first
    line. A paper is one row, so its parents are made distinct within the row.
    """
    if mode not in ("first", "all"):
        raise ValueError("mode must be 'first' or 'all'")
    filled = papers.filter(F.col(categories) != "")
    if mode == "first":
        parents = filled.select(
            label, F.substring_index(categories, separator, 1).alias("parent")
        )
    else:
        tops = F.transform(
            split_lines(F.col(categories)), lambda line: F.substring_index(line, separator, 1)
        )
        parents = filled.select(label, F.explode(F.array_distinct(tops)).alias("parent"))
    return parents.groupBy(label, "parent").agg(F.count(F.lit(1)).alias("papers"))


def path_nodes(
    paths: DataFrame, label: str, path: str = "path", separator: str = fixed.PATH_SEPARATOR
) -> DataFrame:
    """Every node of the class's tree: each prefix of each path, once.

    Columns: label, path (array), depth, name, parent (array, empty at the top).
    """
    parts = split_path(F.col(path), separator)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("parts")), lambda n: F.slice("parts", F.lit(1), n)
    )
    nodes = (
        paths.select(label, parts.alias("parts"))
        .select(label, F.explode(prefixes).alias("path"))
        .distinct()
    )
    depth = F.size("path")
    return nodes.select(
        label,
        "path",
        depth.cast("bigint").alias("depth"),
        F.element_at("path", -1).alias("name"),
        F.slice("path", F.lit(1), depth - 1).alias("parent"),
    )


def tree_listing(nodes: DataFrame, label: str, indent: str = "---") -> DataFrame:
    """Indented names, sorted so that parents precede their children."""
    return nodes.orderBy(label, "path").select(
        label,
        "path",
        F.concat(F.repeat(F.lit(indent), (F.col("depth") - 1).cast("int")), F.col("name")).alias(
            "line"
        ),
    )


def leaf_paths(nodes: DataFrame, label: str, separator: str = fixed.PATH_SEPARATOR) -> DataFrame:
    """Full paths of the nodes without children; the inverse of ``path_nodes``."""
    parents = nodes.filter(F.size("parent") > 0).select(label, F.col("parent").alias("path"))
    return nodes.join(parents.distinct(), [label, "path"], "left_anti").select(
        label, F.array_join("path", separator).alias("path")
    )
