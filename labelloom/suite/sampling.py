"""Samples, splits, numbering and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.operators import batching, sampling
from labelloom.plans import splits
from labelloom.suite.registry import query, sql_key, sql_random, table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang")


@query(
    f"""select doc_id, lang from (select *, row_number() over
      (partition by lang order by {sql_key(42, 'doc_id')}, doc_id) as rn from documents) where rn <= 1"""
)
def one_per_group(spark, sf_dir):
    return sampling.sample_per_group(_documents(spark, sf_dir), "lang", "doc_id")


@query(
    f"""select doc_id, lang from (select *, row_number() over
      (partition by lang order by {sql_key(7, 'doc_id')}, doc_id) as rn from documents) where rn <= 25"""
)
def sample_per_group(spark, sf_dir):
    return sampling.sample_per_group(_documents(spark, sf_dir), "lang", "doc_id", n=25, seed=7)


def sql_stratified(rows: str, label: str, row_id: str) -> str:
    """CTEs ``quota`` and ``tested`` of a stratified 30 % split of ``rows``."""
    return f"""
    sizes as (select {label} as label, cast(count(*) as hugeint) as n from {rows} group by 1),
    totals as (select sum(n) as total, (sum(n) * 3 + 9) // 10 as test_total from sizes),
    parts as (select label, n * test_total // total as base, n * test_total % total as remainder, test_total
      from sizes, totals),
    quota as (select label, base + case when row_number() over (order by remainder desc, label)
      <= test_total - (select sum(base) from parts) then 1 else 0 end as quota from parts),
    tested as (select {row_id} as tested_id from (select *, row_number() over
      (partition by {label} order by {sql_key(42, row_id)}, {row_id}) as rn from {rows}) r
      join quota on r.{label} = quota.label where rn <= quota)"""


@query(
    f"""with {sql_stratified('documents', 'lang', 'doc_id')}
    select doc_id, lang, case when tested_id is null then 'train' else 'test' end as split
    from documents left join tested on doc_id = tested_id"""
)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_documents(spark, sf_dir), "lang", "doc_id")


_RULE_BASED = f"""with labelled as (
      select doc_id as row_id, lang as label, quality as is_abstract from documents left join labels using (doc_id)),
    firsts as (select row_id as first_id from (select *, row_number() over
      (partition by label order by {sql_key(42, 'row_id')}, row_id) as rn
      from labelled where is_abstract = 1) where rn <= 1),
    rest as (select * from labelled where row_id not in (select first_id from firsts)),
    {sql_stratified('rest', 'label', 'row_id')},
    split as (select row_id, label, case when tested_id is null and first_id is null then 'train'
      else 'test' end as split
      from labelled left join tested on row_id = tested_id left join firsts on row_id = first_id)"""


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        _documents(spark, sf_dir)
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col("lang").alias("label"),
            F.col("quality").alias("is_abstract"),
        )
    )


@query(f"{_RULE_BASED} select row_id, label, split from split")
def rule_based_split(spark, sf_dir):
    return sampling.rule_based_split(_labelled(spark, sf_dir)).select("row_id", "label", "split")


@query(
    f"""{_RULE_BASED} select row_id, label, case when split = 'train' then 'train'
      when {sql_random(42, 'row_id')} < 2147483648 then 'validation' else 'test' end as split from split"""
)
def three_way_split(spark, sf_dir):
    return splits.three_way_split(_labelled(spark, sf_dir)).select("row_id", "label", "split")


@query(
    f"""{_RULE_BASED}, held as (select *, row_number() over (order by {sql_key(42, 'row_id')}, row_id) as rn,
      count(*) over () as n from split where split = 'test')
    select row_id, label, split from split where split = 'train' union all
    select row_id, label, case when rn <= (n + 1) // 2 then 'test' else 'validation' end from held"""
)
def three_way_exact_split(spark, sf_dir):
    split = splits.three_way_split(_labelled(spark, sf_dir), exact=True)
    return split.select("row_id", "label", "split")


@query(
    f"""select doc_id, case when {sql_random(42, 'doc_id')} < 2147483648 then 'validation'
      else 'test' end as split from documents"""
)
def half_split(spark, sf_dir):
    return sampling.bucket_split(_documents(spark, sf_dir).select("doc_id"), "doc_id")


@query(
    f"""select doc_id, case when row_number() over (order by {sql_key(42, 'doc_id')}, doc_id)
      <= (select (count(*) + 1) // 2 from documents) then 'test' else 'validation' end as split
    from documents"""
)
def exact_half_split(spark, sf_dir):
    return sampling.exact_split(_documents(spark, sf_dir).select("doc_id"), "doc_id")


@query(
    f"""select doc_id, row_number() over (order by {sql_key(42, 'doc_id')}, doc_id) as position
    from documents"""
)
def shuffle_rows(spark, sf_dir):
    return sampling.shuffle_rows(_documents(spark, sf_dir).select("doc_id"), "doc_id")


@query(
    """select doc_id, source, n_chars from (select *, row_number() over
      (partition by source order by n_chars desc, doc_id) as rn from documents) where rn <= 100"""
)
def topk_per_topic(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.top_per_group(documents, "source", ["-n_chars", "doc_id"])


@query(
    """select conv_id, turn, role, cast((row_number() over (partition by role order by conv_id, turn) - 1)
      // 20 as bigint) as batch_id from conversations"""
)
def batch_numbers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return batching.number_batches(turns, ["role"], ["conv_id", "turn"])


@query(
    """select role, batch_id, array_to_string(list(conv_id || ':' || turn order by conv_id, turn), ',') as items,
      count(*) as n
    from (select *, cast((row_number() over (partition by role order by conv_id, turn) - 1) // 20 as bigint)
      as batch_id from conversations) group by 1, 2"""
)
def batches(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.concat_ws(":", "conv_id", "turn").alias("item")
    )
    numbered = batching.number_batches(turns, ["role"], ["conv_id", "turn"])
    packed = batching.collect_batches(numbered, ["role"], ["conv_id", "turn"], "item")
    return packed.select(
        "role",
        "batch_id",
        F.array_join("items", ",").alias("items"),
        F.size("items").cast("bigint").alias("n"),
    )
