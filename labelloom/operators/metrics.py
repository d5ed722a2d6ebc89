"""Classification metrics from one pass of confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (label, prediction), pre-aggregated before the shuffle."""
    return df.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    hit = F.col(label).eqNullSafe(F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def class_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support, true positives and F1 per class, F1 being 0 where undefined.

    F1 is 2tp / (2tp + fp + fn), and 2tp + fp + fn is the number of rows
    labelled plus the number of rows predicted.
    """
    counts = confusion(df, label, prediction)
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")

    def side(name: str, tp, labelled, predicted):
        return F.struct(
            F.col(name).alias("class"),
            tp.alias("tp"),
            labelled.alias("labelled"),
            predicted.alias("predicted"),
        )

    sides = counts.select(
        F.inline(
            F.array(
                side("label", hit, F.col("n"), none),
                side("prediction", none, none, F.col("n")),
            )
        )
    )
    whole = F.col("labelled") + F.col("predicted")
    return (
        sides.groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "labelled", "predicted")])
        .select(
            "class",
            F.col("labelled").alias("support"),
            "tp",
            F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0).alias("f1"),
        )
    )


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1 in one row, from one pass over the rows."""
    rows = F.sum("support")
    return class_scores(df, label, prediction).agg(
        (F.sum("tp") / rows).alias("accuracy"),
        (F.sum(F.col("support") * F.col("f1")) / rows).alias("weighted_f1"),
    )


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return report(df, label, prediction).select("weighted_f1")
