"""Corpus preparation, duplicates and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.operators import dedup, filters, lookup, metrics
from labelloom.plans import corpus, null_class
from labelloom.suite.registry import (
    query,
    sql_contains_any,
    sql_language,
    sql_process_text,
    table,
)


def sources(spark, sf_dir):
    """The four kinds of sources, made from the test tables."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    conversations = table(spark, sf_dir, "conversations")
    benchmark = table(spark, sf_dir, "benchmark")
    abstracts = documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("ID"),
        F.col("text").alias("ABSTRACT"),
        F.col("quality").alias("SDG"),
    )
    community = conversations.filter(F.col("role") != "assistant").select(
        "text",
        (F.col("conv_id") % 18).cast("int").alias("sdg"),
        (F.col("turn") % 10 / 10).alias("agreement"),
    )
    null_rows = benchmark.select(
        F.col("item_id").cast("string").alias("id"),
        F.col("text").alias("abstract"),
        F.lit(0).alias("sdg_label"),
    )
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("From Web of Science "), F.col("text"))).otherwise(F.col("text"))
    synthetic = conversations.filter(F.col("role") == "assistant").select(
        marked.alias("text"), (F.col("turn") % 17 + 1).cast("int").alias("sdg_id")
    )
    return abstracts, community, null_rows, synthetic


_ABSTRACTS = "select text, quality as label, 1 as is_abstract from documents left join labels using (doc_id)"
_COMMUNITY = (
    "select text, cast(conv_id % 18 as integer) as label,"
    f" cast({sql_contains_any('lower(text)', fixed.ABSTRACT_MARKERS)} as integer) as is_abstract"
    " from conversations where role <> 'assistant' and turn % 10 / 10 >= 0.5"
)
_NULL = "select text, 0 as label, 1 as is_abstract from benchmark where text is not null"
_SYNTHETIC = (
    "select case when contains(marked, 'Web of Science')"
    " then list_extract(string_split(marked, 'Web of Science '), -1)"
    " when contains(marked, 'abstract') then list_extract(string_split(marked, 'abstract '), -1)"
    " else marked end as text, cast(turn % 17 + 1 as integer) as label, 2 as is_abstract"
    " from (select *, case when turn % 3 = 0 then 'From Web of Science ' || text else text end as marked"
    " from conversations where role = 'assistant')"
)


def _sql_corpus(checked: str, rest: str = "") -> str:
    return f"""
    with checked as (select row_number() over () as rid, * from ({checked})),
    kept as (select text, label, is_abstract from checked
      join {sql_language('checked', 'rid', 'text')} using (rid) where language = 'en'),
    prepared as (select * from kept {rest})
    select {sql_process_text('text')} as text_clean, label, is_abstract from prepared"""


@query(_sql_corpus(f"select * from ({_ABSTRACTS} union all {_COMMUNITY}) where label is distinct from 0"))
def prepare_corpus(spark, sf_dir):
    """Two sources; class 0 is removed."""
    abstracts, community, _, _ = sources(spark, sf_dir)
    return corpus.prepare_corpus(abstracts, community)


@query(
    _sql_corpus(f"{_ABSTRACTS} union all {_COMMUNITY} union all {_NULL}", f"union all {_SYNTHETIC}")
)
def prepare_full_corpus(spark, sf_dir):
    """All four sources; synthetic texts are not language-checked."""
    return corpus.prepare_corpus(*sources(spark, sf_dir))


@query(
    f"select * from (select * from ({_ABSTRACTS}) union all select * from ({_COMMUNITY})"
    f" union all select * from ({_NULL}) union all select * from ({_SYNTHETIC}))"
)
def union_sources(spark, sf_dir):
    abstracts, community, null_rows, synthetic = sources(spark, sf_dir)
    return lookup.union_all(
        corpus.from_abstracts(abstracts),
        corpus.from_community(community),
        corpus.from_null_class(null_rows),
        corpus.from_synthetic(synthetic),
    )


@query(
    "select conv_id, turn, turn % 10 / 10 as agreement from conversations where turn % 10 / 10 >= 0.3"
)
def min_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", (F.col("turn") % 10 / 10).alias("agreement")
    )
    return filters.min_agreement(rows, 0.3)


@query("select doc_id, quality from labels where quality is distinct from 0")
def exclude_class_zero(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return filters.exclude_class(labels, 0, "quality")


@query("select doc_id, toxic from labels where quality = 1")
def provenance_filter(spark, sf_dir):
    return filters.only_provenance(table(spark, sf_dir, "labels"), 1, "quality").select("doc_id", "toxic")


@query("select distinct text, lang, source, n_chars from documents")
def dedup_rows(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return dedup.distinct_rows(documents.select("text", "lang", "source", "n_chars"))


@query(
    "select doc_id, text from (select doc_id, text,"
    " row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1"
)
def dedup_texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.distinct_on(documents, ["text"], "doc_id")


@query(
    """select distinct cast(doc_id as varchar) as id, lang as title, text as abstract,
      lang || ';' || source as field, 0 as sdg_relation, 0 as sdg_label
    from documents where doc_id % 9 <> 0"""
)
def null_class_corpus(spark, sf_dir):
    """Every hit counts; every ninth lacks its abstract and is skipped."""
    hits = table(spark, sf_dir, "documents").select(
        F.col("source").alias("topic"),
        F.col("doc_id").alias("rank"),
        F.col("doc_id").cast("string").alias("paperId"),
        F.col("lang").alias("title"),
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("abstract"),
        F.array("lang", "source").alias("fieldsOfStudy"),
    )
    return null_class.null_class(null_class.topic_rows(hits))


@query("select round(avg(cast(quality = toxic as double)), 6) as accuracy from labels")
def accuracy(spark, sf_dir):
    scores = metrics.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")
    return scores.select(F.round("accuracy", 6).alias("accuracy"))


_CLASS_SCORES = """
    with classes as (select quality as class from labels union select toxic from labels),
    f as (select class,
      (select count(*) from labels where quality = class) as support,
      (select count(*) from labels where toxic = class) as predicted,
      (select count(*) from labels where quality = class and toxic = class) as tp
      from classes)"""


@query(
    _CLASS_SCORES
    + " select class, support, tp, round(case when support + predicted > 0"
    " then 2 * tp / (support + predicted) else 0 end, 6) as f1 from f"
)
def class_scores(spark, sf_dir):
    scores = metrics.class_scores(table(spark, sf_dir, "labels"), "quality", "toxic")
    return scores.select("class", "support", "tp", F.round("f1", 6).alias("f1"))


@query(
    _CLASS_SCORES
    + " select round(sum(support * 2 * tp / (support + predicted)) / sum(support), 6) as weighted_f1 from f"
)
def weighted_f1(spark, sf_dir):
    score = metrics.weighted_f1(table(spark, sf_dir, "labels"), "quality", "toxic")
    return score.select(F.round("weighted_f1", 6).alias("weighted_f1"))


@query("select quality as label, toxic as prediction, count(*) as n from labels group by 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")
