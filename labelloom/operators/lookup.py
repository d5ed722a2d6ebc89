"""Lookups and joins.

No frame is broadcast by hint: the planner does so where it can prove the
size, and adaptive execution splits hot keys of the remaining shuffle joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators import bloom


def union_all(*frames: DataFrame) -> DataFrame:
    """Bag union by column name; missing columns become null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def first_match(
    left: DataFrame, right: DataFrame, key: str, order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Inner join with the first right row per key.

    The right side is reduced by ``min_by`` before the shuffle, so repeated
    keys cost nothing there; each left row keeps one partner at most.
    """
    first = right.groupBy(key).agg(
        F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    )
    return left.join(first, key).select(
        *[left[c] for c in left.columns], *[F.col("_first")[v].alias(v) for v in values]
    )


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows without a partner: the data-quality side of a lookup."""
    return left.join(right.select(key), key, "left_anti")


def skip_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be processed."""
    return unmatched(todo, done, key)


def unique_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key (the smallest where a key has several)."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def flatten_unique(df: DataFrame, array_column: str, name: str) -> DataFrame:
    """Distinct elements of an array column."""
    return df.select(F.explode(array_column).alias(name)).distinct()


def skip_named(
    topics: DataFrame,
    files: DataFrame,
    topic: str = "topic",
    file_name: str = "name",
    extension: str = ".csv",
    exact: bool = True,
) -> DataFrame:
    """Topics for which no file exists yet.

    With ``exact=False`` a file counts if its name merely ends with the topic's
    file name. That test becomes an equality join on suffixes of the file names. Only
    suffixes as long as some topic's file name are cut, and only those that a Bloom filter
    of the topics lets pass are shuffled.
    """
    wanted = topics.withColumn("_file", F.concat(F.col(topic), F.lit(extension)))
    names = files.select(F.col(file_name).alias("_file"))
    if not exact:
        # File names are short, so there are few lengths.
        lengths = sorted(r["n"] for r in wanted.select(F.length("_file").alias("n")).distinct().collect() if r["n"])
        listed = F.array(*map(F.lit, lengths)).cast("array<int>")
        fitting = F.filter(listed, lambda n: n <= F.length("_file"))
        suffixes = names.select(F.explode(F.transform(fitting, lambda n: F.right("_file", n))).alias("_file"))
        names = suffixes.filter(bloom.build(wanted, "_file").may_contain(F.col("_file")))
    return wanted.join(names.distinct(), "_file", "left_anti").drop("_file")


def zip_by_key(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pair requests with their answers; the second frame has those unanswered.

    An answer that landed twice counts once: of several the least row is taken.
    """
    others = [c for c in right.columns if c != key]
    once = right.groupBy(key).agg(F.min(F.struct(*others)).alias("_answer")).select(key, "_answer.*") if others else right.distinct()
    return left.join(once, key), unmatched(left, once, key)


def plan_versus_actual(
    plan: DataFrame, actual: DataFrame, label: str, planned: str = "planned"
) -> DataFrame:
    """Per planned class the rows that exist and those still missing."""
    counts = actual.groupBy(label).agg(F.count(F.lit(1)).alias("actual"))
    found = F.coalesce(F.col("actual"), F.lit(0)).cast("bigint")
    return plan.join(counts, label, "left").select(
        label,
        F.col(planned).cast("bigint").alias("planned"),
        found.alias("actual"),
        (F.col(planned).cast("bigint") - found).alias("missing"),
    )

