"""Language profiles learned from labelled text, and detection by join.

``learn_profiles`` and ``detect_by_join`` compare shares of whole words and always name
one of the languages that share a word with the text. ``learn_letters`` and
``detect_open_set`` compare runs of three characters and may name none: a text that fits
its best language much worse than that language's own texts do, or hardly better than
the next language, is of no known language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.lambdas import map_items
from labelloom.functions.language import UNKNOWN, word_tokens
from labelloom.sources.staging import stage

#: Parts in which a token's share in its language is counted.
PARTS = 1_000_000_000_000


def _word_counts(df: DataFrame, text: str, language: str) -> DataFrame:
    tokens = df.select(F.col(language).alias("lang"), F.explode(word_tokens(F.col(text))).alias("token"))
    return stage(tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n")), "tokens")


def learn_profiles(
    df: DataFrame, text: str = "text", language: str = "lang"
) -> DataFrame:
    """All tokens per language as (lang, token, weight).

    The weight is the token's share in its language, in parts per ``PARTS`` and rounded
    up, so that no token weighs nothing, however long the corpus. The texts are read once: their token counts (pre-aggregated before the shuffle)
    are staged, and the totals read that table.
    """
    counts = _word_counts(df, text, language)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    parts = F.col("n").cast("decimal(38,0)") * PARTS
    whole = (parts - parts % F.col("total")) / F.col("total") + (parts % F.col("total") > 0).cast("int")
    return counts.join(totals, "lang").select("lang", "token", whole.cast("bigint").alias("weight"))


def detect_by_join(
    df: DataFrame, profiles: DataFrame, row_id: str, text: str = "text"
) -> DataFrame:
    """(row id, language) for every row, from a profile table of any size.

    Sums per row are formed before the shuffle, so a text moves as at most one
    record per language. A text without a known token has the language
    ``error``.
    """
    # Words are counted per row before they move: a frequent word of a text moves once.
    tokens = (
        df.select(row_id, F.explode_outer(word_tokens(F.col(text))).alias("token"))
        .groupBy(row_id, "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scored = (
        tokens.join(profiles, "token", "left")
        .groupBy(row_id, "lang")
        .agg(F.sum(F.col("weight") * F.col("n")).alias("score"))
    )
    # The smallest (negated score, name) is the best language, ties by name;
    # records without a language are null and do not compete.
    best = F.min(
        F.when(F.col("lang").isNotNull(), F.struct((-F.col("score")).alias("s"), F.col("lang")))
    )
    return scored.groupBy(row_id).agg(
        F.coalesce(best["lang"], F.lit(UNKNOWN)).alias("language")
    )


# --- open set: runs of three characters -------------------------------------------------

#: Parts of a natural logarithm in which weights are counted.
LOG_PARTS = 1_000
#: Share of a language's own mean gain, in hundredths, that a text of it reaches at least, and
#: how much better than the next language it is per run, in parts of a logarithm.
LEAST_SHARE, MARGIN = 85, 50


@dataclass
class Letters:
    """Profiles: (gram, one gain per language), and (language, unseen weight, typical gain) in the same order."""

    gains: DataFrame
    languages: list[tuple[str, int, int]]


def letter_runs(words: Column) -> Column:
    """Runs of three characters of words with a blank on both sides, one per letter."""
    runs = "transform(sequence(1, length(w)), i -> substr(concat(' ', w, ' '), i, 3))"
    return F.flatten(map_items(words, runs))


def letter_gains(df: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(lang, gram, n, gain): what a run adds to a language beyond an unseen one, with add-one smoothing.

    Runs are counted from the staged word counts, so the work beyond one pass over the
    texts grows with the vocabulary. Rows without a language or a text count nothing.
    """
    words = _word_counts(df.filter(F.col(language).isNotNull()), text, language)
    runs = words.select("lang", "n", F.explode(letter_runs(F.array("token"))).alias("gram"))
    counts = runs.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    gain = F.round(F.log(F.col("n") + F.lit(1.0)) * LOG_PARTS).cast("bigint")
    return stage(counts.withColumn("gain", gain), "letter-gains")


def learn_letters(df: DataFrame, text: str = "text", language: str = "lang") -> Letters:
    """Profiles of all languages of a labelled frame; the driver holds three values per language."""
    gains = letter_gains(df, text, language)
    distinct = gains.select("gram").distinct().count()
    sums = gains.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("gain")).alias("gained"))
    unseen = F.round(F.log(F.lit(1.0) / (F.col("total") + F.lit(float(distinct)))) * LOG_PARTS).cast("bigint")
    listed = sums.select("lang", unseen.alias("unseen"), F.expr("gained div total").alias("typical")).collect()
    languages = sorted((r["lang"], r["unseen"], r["typical"]) for r in listed)
    columns = [
        F.coalesce(F.max(F.when(F.col("lang") == name, F.col("gain"))), F.lit(0)).alias(f"gain_{k}")
        for k, (name, _, _) in enumerate(languages)
    ]
    if not columns:
        return Letters(gains.select("gram"), [])
    return Letters(stage(gains.groupBy("gram").agg(*columns), "letters"), languages)


def detect_open_set(
    df: DataFrame, letters: Letters, row_id: str, text: str = "text", least_share: int = LEAST_SHARE, margin: int = MARGIN
) -> DataFrame:
    """(row id, language) for every row id; ``error`` where no known language fits.

    A text is of its best language if its mean gain per run reaches ``least_share``
    hundredths of that of the language's own texts, and its mean weight leads the next
    language's by ``margin``.
    Runs are counted per row before they move. Ties go to the first name; null and
    empty texts are of no language; rows with one id count as one text.
    """
    runs = (
        df.select(row_id, F.explode_outer(letter_runs(word_tokens(F.col(text)))).alias("gram"))
        .groupBy(row_id, "gram")
        .agg(F.count("gram").alias("n"))
    )
    sums = runs.join(letters.gains, "gram", "left").groupBy(row_id).agg(
        F.sum("n").alias("runs"),
        *[F.sum(F.col("n") * F.col(f"gain_{k}")).alias(f"sum_{k}") for k in range(len(letters.languages))],
    )
    if not letters.languages:
        return sums.select(row_id, F.lit(UNKNOWN).alias("language"))
    scores = F.array(
        *[
            F.struct(
                (F.coalesce(f"sum_{k}", F.lit(0)) + F.col("runs") * unseen).alias("score"),
                F.lit(-k).alias("order"),
                F.lit(name).alias("lang"),
                (100 * F.coalesce(f"sum_{k}", F.lit(0)) - F.col("runs") * typical * least_share).alias("over"),
            )
            for k, (name, unseen, typical) in enumerate(letters.languages)
        ]
    )
    ranked = sums.select(row_id, "runs", F.sort_array(scores, asc=False).alias("ranked"))
    first, second = F.col("ranked")[0], F.get("ranked", F.lit(1))
    fits = first["over"] >= 0
    leads = second.isNull() | (first["score"] - second["score"] >= margin * F.col("runs"))
    known = (F.col("runs") > 0) & fits & leads
    return ranked.select(row_id, F.when(known, first["lang"]).otherwise(UNKNOWN).alias("language"))
