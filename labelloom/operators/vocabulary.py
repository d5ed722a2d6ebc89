"""Noun lemmas with a dictionary test against a vocabulary table.

An exception table comes first. Otherwise the published suffix rules propose forms,
then forms of these forms and so on until nothing is left to cut; the first round in
which a form is in the vocabulary decides, and of that round the shortest. The work is
done once per distinct token, so it grows with the vocabulary of the corpus and not
with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.sources.staging import stage

# --- fixed values: published suffix rules for nouns ------------------------------
NOUN_RULES = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)


def distinct_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).distinct()


#: A token is frequent from this share of all tokens on, so at most as many are frequent as its inverse.
FREQUENT = 1e-4


def default_exceptions(df: DataFrame) -> DataFrame:
    """The short exception list of the library as a table (token, lemma), on the session of a frame."""
    return df.sparkSession.createDataFrame(list(fixed.LEMMA_IRREGULAR.items()), "token string, lemma string")


def _forms() -> str:
    """All forms of the word ``token``: (round, length, rule, word), in SQL.

    Every rule but men-man makes a word shorter and that one makes no further form, so
    there are at most as many rounds as letters.
    """
    cuts = ", ".join(
        f"if(endswith(f.word, '{old}'), named_struct('round', r, 'length', length(f.word) - {len(old) - len(new)}, 'rule', {k + 1},"
        f" 'word', concat(left(f.word, length(f.word) - {len(old)}), '{new}')), null)"
        for k, (old, new) in enumerate(NOUN_RULES)
    )
    first = "array(named_struct('round', 1, 'length', length(token), 'rule', 0, 'word', token))"
    step = f"""named_struct('all', concat(s.all, s.last), 'last',
        array_distinct(flatten(transform(s.last, f -> filter(array({cuts}), x -> x is not null)))))"""
    # The word itself belongs to the first round, together with its first forms.
    return f"""aggregate(sequence(1, length(token)), named_struct('all', filter({first}, x -> false), 'last', {first}),
        (s, r) -> {step}, s -> concat(s.all, s.last))"""


def lemma_table(
    tokens: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None
) -> DataFrame:
    """(token, lemma) for distinct tokens; ``vocabulary`` has a column ``word``.

    ``exceptions`` (token, lemma) go before the rules where token or lemma is in the
    vocabulary; of several lemmas the shortest counts. A token without any form in
    the vocabulary is its own lemma. Ties in length go to the token, then to the earlier rule.
    """
    words = vocabulary.select("word").distinct()
    formed = tokens.select("token", F.explode(F.expr(_forms())).alias("f")).select("token", "f.*")
    if exceptions is None:
        exceptions = tokens.limit(0).select("token", F.col("token").alias("lemma"))
    # A token with exceptions has these and itself, in a round before all others.
    listed = tokens.join(exceptions.select("token", "lemma").distinct(), "token")
    own = listed.select("token", F.explode(F.array("token", "lemma")).alias("word"))
    irregular = own.select(
        "token", F.lit(0).alias("round"), F.length("word").alias("length"), (F.col("word") != F.col("token")).cast("int").alias("rule"), "word"
    )
    known = formed.unionByName(irregular).join(words, "word", "left_semi")
    best = F.min(F.struct("round", "length", "rule", "word"))["word"]
    lemmas = known.groupBy("token").agg(best.alias("lemma"))
    return tokens.join(lemmas, "token", "left").select(
        "token", F.coalesce("lemma", "token").alias("lemma")
    )


def apply_lemmas(
    df: DataFrame, lemmas: DataFrame, row_id: str, tokens: str, frequent: float = FREQUENT
) -> DataFrame:
    """(row id, text_clean): the tokens of each row replaced by their lemmas.

    Only lemmas that differ from their token take part. Tokens that make up ``frequent``
    of all tokens or more, at most 10,000 as it stands, are hot keys of a join: theirs
    are broadcast, which has a bound, and the others are joined by shuffle. A row of a
    frequent token gets a key of its own in that shuffle, so no key is hot. A null array
    counts as empty.
    """
    changed = stage(lemmas.filter(F.col("lemma") != F.col("token")).select("token", "lemma"), "lemmas")
    counts = stage(
        df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token-counts"
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Frequent tokens that stay as they are are listed too: they need no shuffle either.
    hot = counts.filter(F.col("n") >= frequent * total).join(changed, "token", "left")
    hot = stage(hot.select("token", F.coalesce("lemma", "token").alias("_hot")), "frequent-lemmas")
    exploded = df.select(row_id, F.posexplode_outer(tokens).alias("pos", "token"))
    placed = exploded.join(F.broadcast(hot), "token", "left")
    # A token holds letters only, so no key with a blank is one.
    spread = F.concat_ws(" ", F.lit(""), F.xxhash64(row_id, "pos"))
    key = F.when(F.col("_hot").isNull() & F.col("token").isNotNull(), F.col("token")).otherwise(spread)
    rare = changed.select(F.col("token").alias("_key"), F.col("lemma").alias("_rare"))
    looked_up = placed.withColumn("_key", key).join(rare, "_key", "left").select(
        row_id, "pos", F.coalesce("_hot", "_rare", "token").alias("lemma")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "lemma")))
    words = F.transform(ordered, lambda item: item["lemma"])
    return looked_up.groupBy(row_id).agg(F.array_join(words, " ").alias("text_clean"))
