"""Lookups, incremental joins and plan checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import labels
from labelloom.operators import lookup
from labelloom.suite.registry import query, table


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def skip_done(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return lookup.skip_done(documents, table(spark, sf_dir, "labels"), "doc_id")


#: The file of every fifth customer is not finished yet.
_SQL_ENDING = "case when o_custkey % 5 = 0 then '.part' else '.csv' end"


def _file(prefix):
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    return F.concat(F.lit(prefix), number, F.when(F.col("o_custkey") % 5 == 0, ".part").otherwise(".csv")).alias("name")


@query(
    f"""with topics as (select distinct c_name as topic from customer),
    files as (select distinct 'orders of Customer#' || lpad(cast(o_custkey as varchar), 9, '0') || {_SQL_ENDING} as name
      from orders)
    select topic from topics where not exists
      (select 1 from files where ends_with(name, topic || '.csv'))"""
)
def suffix_skip(spark, sf_dir):
    topics = table(spark, sf_dir, "customer").select(F.col("c_name").alias("topic")).distinct()
    files = table(spark, sf_dir, "orders").select(_file("orders of Customer#"))
    return lookup.skip_named(topics, files, exact=False)


@query(
    f"""select distinct c_name as topic from customer where c_name || '.csv' not in
    (select 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0') || {_SQL_ENDING} from orders)"""
)
def exact_skip(spark, sf_dir):
    topics = table(spark, sf_dir, "customer").select(F.col("c_name").alias("topic")).distinct()
    files = table(spark, sf_dir, "orders").select(_file("Customer#"))
    return lookup.skip_named(topics, files)


@query(
    """with first as (select o_custkey, o_orderkey, o_orderpriority, row_number() over
      (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders)
    select c_custkey, o_orderkey, o_orderpriority from customer join first on c_custkey = o_custkey
    where rn = 1"""
)
def first_match_join(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").withColumn("c_custkey", F.col("o_custkey"))
    return lookup.first_match(
        customers, orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"]
    )


@query(
    """select l_orderkey, l_partkey, l_suppkey, l_linenumber, o_orderstatus from lineitem
    join orders on l_orderkey = o_orderkey"""
)
def lookup_join(spark, sf_dir):
    """Each line item with its order's first (and only) status."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return lookup.first_match(lines, orders, "l_orderkey", ["o_orderdate"], ["o_orderstatus"])


@query(
    """select c_custkey from customer where c_custkey not in
    (select o_custkey from orders where o_custkey is not null and o_custkey % 5 <> 0)"""
)
def unmatched_ids(spark, sf_dir):
    """The customer of every fifth key is not known to its orders."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("c_custkey"))
    return lookup.unmatched(customers, orders, "c_custkey")


@query("select p_size, min(p_name) as p_name from part group by 1")
def unique_mapping(spark, sf_dir):
    return lookup.unique_mapping(table(spark, sf_dir, "part"), "p_size", "p_name")


@query("select distinct o_orderpriority from orders")
def unique_values(spark, sf_dir):
    return lookup.unique_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select distinct unnest(string_split(p_name, ' ')) as keyword from part")
def flatten_unique(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("keywords"))
    return lookup.flatten_unique(words, "keywords", "keyword")


@query(
    """select p_size as label, planned, coalesce(actual, 0) as actual, planned - coalesce(actual, 0) as missing
    from (select p_size, count(*) as planned from part group by 1)
    left join (select l_linenumber * 5 as label, count(*) as actual from lineitem group by 1)
      on p_size = label"""
)
def plan_vs_actual(spark, sf_dir):
    plan = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("label")).agg(
        F.count(F.lit(1)).alias("planned")
    )
    actual = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 5).alias("label"))
    return lookup.plan_versus_actual(plan, actual, "label")


_MODELS = tuple(fixed.MODEL_SHORT_NAMES)


@query(
    f"""select event_id, case event_type when 'click' then '{fixed.MODEL_SHORT_NAMES[_MODELS[0]]}'
      when 'view' then '{fixed.MODEL_SHORT_NAMES[_MODELS[1]]}' else event_type end as model from events"""
)
def model_names(spark, sf_dir):
    listed = (
        F.when(F.col("event_type") == "click", _MODELS[0])
        .when(F.col("event_type") == "view", _MODELS[1])
        .otherwise(F.col("event_type"))
    )
    events = table(spark, sf_dir, "events")
    return events.select("event_id", labels.model_short_name(listed).alias("model"))


@query("select l_returnflag, count(*) as n from lineitem group by 1")
def count_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
