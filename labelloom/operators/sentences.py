"""Abbreviations learned without labels, and tokens that follow them.

A full stop belongs to a word if the word nearly always has one. The published model
(Kiss and Strunk 2006) compares, for every word, two explanations of how often it is
followed by a stop: the corpus's share of stops, and 0.99. The log-likelihood ratio is
weighted: short words, inner stops, and never standing without a stop speak for an
abbreviation. All counts are aggregations over the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.sources.staging import stage

# --- fixed values of the published model -------------------------------------------------
#: Share of stops behind an abbreviation, and the least score of one.
ABBREVIATION_SHARE, LEAST_SCORE = 0.99, 0.3

#: A run of letters and digits with inner stops, and the stop behind it.
TYPE = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*\.?"
#: Types that may be abbreviations: letters and inner stops.
WORD = r"^\p{L}+(?:\.\p{L}+)*$"
#: Most abbreviations that travel in the plan; more are joined.
MOST_LITERALS = 10_000


def stop_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, with_stop, without_stop) of all lower-case types of a corpus."""
    types = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TYPE), F.lit(0))).alias("type"))
    # Both forms are counted before the shuffle and meet under the form without the stop.
    counts = types.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    stopped = F.col("type").endswith(".")
    return counts.groupBy(F.rtrim("type", F.lit(".")).alias("token")).agg(
        F.sum(F.when(stopped, F.col("n")).otherwise(0)).alias("with_stop"),
        F.sum(F.when(stopped, 0).otherwise(F.col("n"))).alias("without_stop"),
    )


def abbreviation_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """(token, with_stop, without_stop, score) of the words that occur with a stop.

    Null texts count nothing. A corpus without stops, or of stops alone, has no scores
    above 0. Scores are rounded to six places.
    """
    counts = stage(stop_counts(df, text), "stops")
    sums = counts.agg(
        F.coalesce(F.sum("with_stop"), F.lit(0)).alias("stops"),
        F.coalesce(F.sum(F.col("with_stop") + F.col("without_stop")), F.lit(0)).alias("types"),
    ).first()
    share = min(sums["stops"] / sums["types"], ABBREVIATION_SHARE) if sums["types"] else ABBREVIATION_SHARE
    k, rest = F.col("with_stop"), F.col("without_stop")

    def likelihood(p: float):
        return k * F.log(F.lit(p)) + rest * F.log(F.lit(1 - p))

    ratio = -2 * (likelihood(share) - likelihood(ABBREVIATION_SHARE))
    inner = F.length("token") - F.length(F.replace("token", F.lit("."), F.lit("")))
    length = F.length("token") - inner
    score = ratio * F.exp(-length) * (inner + 1) * F.pow(length.cast("double"), -rest.cast("double"))
    words = counts.filter((k > 0) & F.col("token").rlike(WORD))
    return words.select("token", "with_stop", "without_stop", F.round(score, 6).alias("score"))


def learn_abbreviations(df: DataFrame, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(token, score) of the words whose stop belongs to them."""
    scores = abbreviation_scores(df, text)
    return stage(scores.filter(F.col("score") >= least).select("token", "score"), "abbreviations")


def tokens_with(
    df: DataFrame, abbreviations: DataFrame, row_id: str, text: str = "text", most_literals: int = MOST_LITERALS
) -> DataFrame:
    """The frame with the column ``tokens``: its alphabetic words under a table (token, score) of abbreviations.

    The table decides which full stops end a sentence. As long as it has at most
    ``most_literals`` rows it travels in the plan and the texts do not move. Beyond that the
    words in front of stops are joined with it, once per row, and come back to their
    rows by the row id, which has to be unique and not null. Both ways give the same tokens.
    """
    clean = T.clean_before_tokens(F.col(text))
    listed = [r["token"] for r in abbreviations.select("token").distinct().limit(most_literals + 1).collect()]
    if len(listed) <= most_literals:
        return df.withColumn("tokens", T.alpha_tokens(clean, listed))
    asked = df.select(row_id, F.explode(T.stopped_words(clean)).alias("token"))
    known = asked.join(abbreviations.select("token").distinct(), "token", "left_semi")
    own = known.groupBy(F.col(row_id).alias("_row")).agg(F.collect_set("token").alias("_known"))
    joined = df.join(own, df[row_id] == F.col("_row"), "left")
    known = F.coalesce("_known", F.array().cast("array<string>"))
    return joined.withColumn("tokens", T.alpha_tokens(clean, known)).select(*[df[c] for c in df.columns], "tokens")
