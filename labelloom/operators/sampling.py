"""Reproducible random samples and splits with exact sizes.

Randomness is a function of (seed, row id), see ``functions.hashing``. The
splits read only the label and row id columns in their preparing passes, and
the final pass compares every row with one cut per label: the rows themselves
are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.hashing import random_key
from labelloom.operators.ranking import (
    first_per_group,
    random_position,
    smallest_k_cut,
)
from labelloom.sources.staging import stage

_KEY = "_key"


def _keyed(df: DataFrame, seed: int | str, row_id: str) -> DataFrame:
    return df.withColumn(_KEY, random_key(seed, F.col(row_id)))


def sample_per_group(
    df: DataFrame, label: str, row_id: str, n: int = 1, seed: int | str = fixed.SPLIT_SEED
) -> DataFrame:
    """n random rows per label (all of them where a label has fewer).

    The source is read twice: for the staged keys, and for the result.
    """
    keyed = _keyed(df, seed, row_id)
    keys = stage(keyed.select(label, row_id, _KEY), "keys")
    cut = smallest_k_cut(keys, label, _KEY, row_id, _at_most(label, n))
    return _below_cut(keyed, cut, label, row_id, "_taken").filter("_taken").drop(_KEY, "_taken")


def _at_most(label: str, n: int) -> Callable[[DataFrame], DataFrame]:
    """Quotas of n rows, or all of a smaller label."""
    return lambda sizes: sizes.select(label, F.least("n", F.lit(n)).cast("bigint").alias("quota"))


def _share_fraction(share: str) -> tuple[int, int]:
    numerator, denominator = Decimal(share).as_integer_ratio()
    if not 0 < numerator < denominator:
        raise ValueError("a share must lie between 0 and 1")
    return numerator, denominator


def stratified_quotas(counts: DataFrame, label: str, share: str) -> DataFrame:
    """Test rows per label from the label sizes ``(label, n)``.

    The test part has ceil(share * total) rows. Every label gets the integer
    part of its proportional number, and the largest remainders (ties: the
    smaller label first) get one more until the total is met. Integers only.
    The frame has one row per class, so its windows, which have no key, are small.
    """
    numerator, denominator = _share_fraction(share)
    whole = Window.partitionBy()
    exact = "decimal(19,0)"
    sized = counts.select(
        label,
        F.col("n").cast(exact).alias("n"),
        F.sum("n").over(whole).cast(exact).alias("total"),
        F.count(F.lit(1)).over(whole).alias("labels"),
    )
    test_total = F.ceil(F.col("total") * numerator / F.lit(denominator).cast(exact))
    sized = sized.withColumn("test_total", test_total.cast(exact))
    product = F.col("n") * F.col("test_total")
    remainder = product % F.col("total")
    by_remainder = Window.partitionBy().orderBy(F.col("remainder").desc(), F.col(label))
    valid = (
        F.when(F.col("n") < 2, F.raise_error(F.lit("a label has fewer than 2 rows")))
        .when(
            (F.col("test_total") < F.col("labels"))
            | (F.col("total") - F.col("test_total") < F.col("labels")),
            F.raise_error(F.lit("a part is smaller than the number of labels")),
        )
        .otherwise(F.lit(0))
    )
    base = sized.select(
        label,
        "test_total",
        ((product - remainder) / F.col("total")).cast("bigint").alias("base"),
        remainder.alias("remainder"),
        valid.alias("valid"),
    )
    missing = F.col("test_total") - F.sum("base").over(whole)
    return base.select(
        label,
        (
            F.col("base")
            + (F.row_number().over(by_remainder) <= missing).cast("bigint")
            + F.col("valid")
        )
        .cast("bigint")
        .alias("quota"),
    )


def _below_cut(df: DataFrame, cut: DataFrame, label: str, row_id: str, name: str) -> DataFrame:
    """Mark the rows up to their label's cut; the cut table is one row per label."""
    joined = df.join(
        cut.select(F.col(label).alias("_label"), F.col("cut").alias("_cut")),
        df[label].eqNullSafe(F.col("_label")),
        "left",
    )
    below = F.struct(_KEY, row_id) <= F.col("_cut")
    return joined.withColumn(name, F.coalesce(below, F.lit(False))).drop("_label", "_cut")


def stratified_split(
    df: DataFrame,
    label: str,
    row_id: str,
    share: str = fixed.TEST_SHARE,
    seed: int | str = fixed.SPLIT_SEED,
) -> DataFrame:
    """Add ``split`` (train or test) with the same label shares in both parts."""
    keyed = _keyed(df, seed, row_id)
    # The source is read twice: for the staged keys, and for the result.
    keys = stage(keyed.select(label, row_id, _KEY), "keys")
    cut = smallest_k_cut(
        keys, label, _KEY, row_id, lambda sizes: stratified_quotas(sizes, label, share)
    )
    marked = _below_cut(keyed, cut, label, row_id, "_test")
    return _with_split(marked, F.col("_test")).drop(_KEY, "_test")


def _with_split(df: DataFrame, is_test: Column) -> DataFrame:
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def split_keys(
    df: DataFrame, label: str, row_id: str, eligible: str, seed: int | str = fixed.SPLIT_SEED
) -> DataFrame:
    """The columns that decide about a rule-based split, staged: one pass over the source."""
    return stage(_keyed(df, seed, row_id).select(label, row_id, eligible, _KEY), "keys")


def rule_based_cuts(
    keys: DataFrame, label: str, row_id: str, eligible: str, n: int = 1, share: str = fixed.TEST_SHARE
) -> tuple[DataFrame, DataFrame]:
    """Per label the last guaranteed row and the last row of the stratified test part."""
    first = smallest_k_cut(
        keys.filter(_eligible(eligible)).select(label, _KEY, row_id), label, _KEY, row_id, _at_most(label, n)
    )
    rest = _mark_first(keys, first, label, row_id, eligible).filter(~F.col("_first"))
    cut = smallest_k_cut(
        rest, label, _KEY, row_id, lambda sizes: stratified_quotas(sizes, label, share)
    )
    return first, cut


def _eligible(eligible: str) -> Column:
    return F.coalesce(F.col(eligible) == fixed.IS_ABSTRACT, F.lit(False))


def _mark_first(keyed: DataFrame, first: DataFrame, label: str, row_id: str, eligible: str) -> DataFrame:
    marked = _below_cut(keyed, first, label, row_id, "_first")
    return marked.withColumn("_first", F.col("_first") & _eligible(eligible))


def apply_cuts(
    df: DataFrame,
    cuts: tuple[DataFrame, DataFrame],
    label: str,
    row_id: str,
    eligible: str,
    seed: int | str = fixed.SPLIT_SEED,
) -> DataFrame:
    """Add ``split`` by comparing every row with its label's two cuts; rows do not move."""
    first, cut = cuts
    marked = _mark_first(_keyed(df, seed, row_id), first, label, row_id, eligible)
    marked = _below_cut(marked, cut, label, row_id, "_test")
    is_test = F.col("_first") | F.col("_test")
    return _with_split(marked, is_test).drop(_KEY, "_first", "_test")


def rule_based_split(
    df: DataFrame,
    label: str = "label",
    row_id: str = "row_id",
    eligible: str = "is_abstract",
    n: int = 1,
    share: str = fixed.TEST_SHARE,
    seed: int | str = fixed.SPLIT_SEED,
) -> DataFrame:
    """Add ``split``: n abstracts per label go to test, the rest is stratified.

    Every label that has an abstract occurs in the test part. The source is read
    twice: for the staged keys, and for the result.
    """
    keys = split_keys(df, label, row_id, eligible, seed)
    cuts = rule_based_cuts(keys, label, row_id, eligible, n, share)
    return apply_cuts(df, cuts, label, row_id, eligible, seed)


def bucket_split(
    df: DataFrame,
    row_id: str,
    names: tuple[str, str] = ("validation", "test"),
    share: str = fixed.VALIDATION_SHARE,
    seed: int | str = fixed.SPLIT_SEED,
) -> DataFrame:
    """Unstratified split by a hash threshold: one pass, sizes are approximate."""
    numerator, denominator = _share_fraction(share)
    limit = 2**32 * (denominator - numerator) // denominator
    digits = F.substring(random_key(seed, F.col(row_id)), 1, 8)
    first = F.conv(digits, 16, 10).cast("bigint") < limit
    return df.withColumn("split", F.when(first, names[0]).otherwise(names[1]))


def exact_share(
    df: DataFrame, row_id: str, share: str = fixed.VALIDATION_SHARE, seed: int | str = fixed.SPLIT_SEED
) -> Column:
    """Condition that holds for exactly ceil(share * n) rows of the frame."""
    numerator, denominator = _share_fraction(share)
    keys = stage(_keyed(df, seed, row_id).select(row_id, _KEY, F.lit(0).alias("_all")), "keys")
    exact = "decimal(19,0)"
    quota = F.ceil(F.col("n").cast(exact) * numerator / F.lit(denominator).cast(exact))
    cut = smallest_k_cut(
        keys,
        "_all",
        _KEY,
        row_id,
        lambda sizes: sizes.select("_all", quota.cast("bigint").alias("quota")),
    )
    # One row: the cut is a literal, not a join.
    found = cut.first()
    if found is None:
        return F.lit(False)
    limit = F.struct(
        F.lit(found["cut"][_KEY]), F.lit(found["cut"][row_id]).cast(df.schema[row_id].dataType)
    )
    return F.struct(random_key(seed, F.col(row_id)), F.col(row_id)) <= limit


def exact_split(
    df: DataFrame,
    row_id: str,
    names: tuple[str, str] = ("validation", "test"),
    share: str = fixed.VALIDATION_SHARE,
    seed: int | str = fixed.SPLIT_SEED,
) -> DataFrame:
    """Unstratified split whose second part has exactly ceil(share * n) rows."""
    second = exact_share(df, row_id, share, seed)
    return df.withColumn("split", F.when(second, names[1]).otherwise(names[0]))


def shuffle_rows(
    df: DataFrame, row_id: str, seed: int | str = fixed.SPLIT_SEED, name: str = "position"
) -> DataFrame:
    """Number all rows from 1 in random order (the new index of a shuffled frame)."""
    keyed = _keyed(df, seed, row_id).withColumn("_all", F.lit(0))
    return random_position(keyed, ["_all"], _KEY, row_id, name).drop(_KEY, "_all")


def top_per_group(
    df: DataFrame, group: str, order: list[str], k: int = fixed.HITS_PER_TOPIC
) -> DataFrame:
    """At most k rows per group in the given order; ``-name`` means falling."""
    return first_per_group(df, [group], order, k)
