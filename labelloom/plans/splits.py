"""Train, validation and test data from a cleaned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.labels import label_word
from labelloom.operators.sampling import (
    apply_cuts,
    bucket_split,
    exact_share,
    rule_based_cuts,
    split_keys,
)


def three_way_split(
    df: DataFrame,
    row_id: str = "row_id",
    share: str = fixed.TEST_SHARE,
    seed: int | str = fixed.SPLIT_SEED,
    exact: bool = False,
    label: str = "label",
    eligible: str = "is_abstract",
) -> DataFrame:
    """Rule-based split whose test part is then halved into validation and test.

    ``exact`` fixes the size of the halves at the price of more passes over the
    staged keys; the source is read twice either way.
    """
    keys = split_keys(df, label, row_id, eligible, seed)
    cuts = rule_based_cuts(keys, label, row_id, eligible, share=share)
    first = apply_cuts(df, cuts, label, row_id, eligible, seed)
    if exact:
        held_out = apply_cuts(keys.drop("_key"), cuts, label, row_id, eligible, seed)
        second = exact_share(held_out.filter(F.col("split") == "test"), row_id, seed=seed)
        half = F.when(second, "test").otherwise("validation")
        return first.withColumn("split", F.when(F.col("split") == "train", "train").otherwise(half))
    halved = bucket_split(first.withColumnRenamed("split", "_part"), row_id, ("validation", "test"), seed=seed)
    return halved.withColumn(
        "split", F.when(F.col("_part") == "train", F.lit("train")).otherwise(F.col("split"))
    ).drop("_part")


def with_label_words(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn(label, label_word(F.col(label)))


def training_columns(df: DataFrame) -> DataFrame:
    return df.select("text_clean", "label", "split")
