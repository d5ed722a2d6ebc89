"""Sources and sinks: whole tables written to shared storage and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.operators.sampling import bucket_split
from labelloom.functions.labels import label_word
from labelloom.sources import publish, readers, staging, writers
from labelloom.suite.registry import query, sql_process_text, sql_random, table


@query("select doc_id, '  ' || chr(9) || text || '\"' || lang || '\" ' as text, lang from documents")
def csv_round_trip(spark, sf_dir):
    """Texts hold line feeds, quotes and outer blanks; they survive the CSV sink and source."""
    path = staging.new_path(spark, "csv")
    text = F.concat(F.lit("  \t"), "text", F.lit('"'), "lang", F.lit('" ')).alias("text")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", text, "lang"), path)
    return readers.read_csv(spark, path, "doc_id bigint, text string, lang string")


@query("select event_id, event_type, value, props from events")
def delimited_round_trip(spark, sf_dir):
    path = staging.new_path(spark, "tsv")
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    writers.write_csv(events, path, delimiter="\t")
    schema = "event_id bigint, event_type string, value double, props string"
    return readers.read_data(spark, path, schema, "csv", delimiter="\t", multi_line=False)


@query("select doc_id, text, source from documents")
def jsonl_round_trip(spark, sf_dir):
    path = staging.new_path(spark, "jsonl")
    writers.write_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path)
    return readers.read_data(spark, path, "doc_id bigint, text string, source string")


@query(f"select {sql_process_text('text')} as text_clean, 1 as label, 0 as is_abstract from conversations")
def corpus_round_trip(spark, sf_dir):
    """The cleaned corpus through its CSV sink; empty texts come back empty."""
    from labelloom.plans.corpus import clean

    rows = table(spark, sf_dir, "conversations").select(
        "text", F.lit(1).alias("label"), F.lit(0).alias("is_abstract")
    )
    path = writers.write_corpus(clean(rows), staging.new_path(spark, "corpus"), True, True)
    return readers.read_cleaned(spark, path)


@query(
    """select text, cast(conv_id % 17 + 1 as integer) as sdg_id, role as main_topic,
      cast(turn as varchar) as sub_topic, 'plain' as style, 40 as length, 'llama-3-70b' as model,
      cast(conv_id % 17 + 1 as integer) as sdg_goal, '2024-04-26_12-05' as run_ts
    from conversations"""
)
def generated_round_trip(spark, sf_dir):
    """Append to the model and class folders, read one model back."""
    turns = table(spark, sf_dir, "conversations").select(
        "text",
        (F.col("conv_id") % 17 + 1).cast("int").alias("sdg_id"),
        F.col("role").alias("main_topic"),
        F.col("turn").cast("string").alias("sub_topic"),
        F.lit("plain").alias("style"),
        F.lit(40).alias("length"),
    )
    path = staging.new_path(spark, "generated")
    for model in ("meta-llama/Llama-3-70b-chat-hf", "gpt-3.5-turbo"):
        writers.append_generated(turns, path, model, "2024-04-26_12-05")
    return readers.read_generated(spark, path, "llama-3-70b")


@query("select text from conversations")
def lines_round_trip(spark, sf_dir):
    """One value per line; only texts of one line can be told apart again."""
    path = staging.new_path(spark, "lines")
    texts = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("text")).alias("value"))
    texts.write.text(path)
    read = readers.read_lines(spark, path)
    return read.select(F.from_json("value", "text string")["text"].alias("text"))


@query("select source as topic, doc_id, lang from documents")
def topic_round_trip(spark, sf_dir):
    path = staging.new_path(spark, "topics")
    writers.write_per_topic(
        table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), "doc_id", "lang"), path
    )
    return spark.read.schema("doc_id bigint, lang string, topic string").option("header", True).csv(path)


@query(
    f"""select doc_id, lang, case when {sql_random(42, 'doc_id')} < 2147483648 then 'validation'
      else 'test' end as split from documents"""
)
def split_round_trip(spark, sf_dir):
    path = staging.new_path(spark, "splits")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    writers.write_splits(bucket_split(rows, "doc_id"), path)
    files = {name: f"{path}/split={name}" for name in ("validation", "test")}
    return readers.read_splits(spark, files, "doc_id bigint, lang string")


@query(
    f"""select doc_id, case doc_id % 18 {" ".join(f"when {i} then '{w}'" for i, w in enumerate(fixed.NUMBER_WORDS))} end as label,
      case when {sql_random(42, 'doc_id')} < 2147483648 then 'validation' else 'test' end as split from documents"""
)
def mapped_splits(spark, sf_dir):
    """Splits whose labels are mapped to words and published under the name they were read from."""
    folder = staging.new_path(spark, "published")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 18).cast("int").alias("label"))
    publish.publish(bucket_split(rows, "doc_id"), folder, writers.write_splits)

    def read(schema):
        return lambda spark, path: readers.read_splits(spark, {n: f"{path}/split={n}" for n in ("validation", "test")}, schema)

    words = lambda df: df.withColumn("label", label_word(F.col("label")))
    publish.rewrite(spark, folder, words, read("doc_id bigint, label int"), writers.write_splits)
    return read("doc_id bigint, label string")(spark, publish.current_path(spark, folder))


@query(
    """select cast(item_id as varchar) as id, 'title' as title, text as abstract, 'a;b' as field,
      0 as sdg_relation from benchmark"""
)
def topic_files(spark, sf_dir):
    """A folder of CSV files with columns in two orders, one with an index column; columns go by name."""
    path = staging.new_path(spark, "files")
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("int").alias("_c0"),
        F.col("item_id").cast("string").alias("id"),
        F.lit("title").alias("title"),
        F.col("text").alias("abstract"),
        F.lit("a;b").alias("field"),
        F.lit(0).alias("sdg_relation"),
    )
    writers.write_csv(rows.filter(F.col("_c0") % 2 == 0), path)
    other = rows.filter(F.col("_c0") % 2 == 1).select("abstract", "sdg_relation", "id", "field", "title")
    writers.write_csv(other, path, mode="append")
    return readers.read_topic_files(spark, path)


@query(
    """select text, cast(conv_id % 17 + 1 as integer) as sdg_id, role as main_topic,
      cast(turn as varchar) as sub_topic, 'plain' as style, 40 as length from conversations"""
)
def model_tree(spark, sf_dir):
    """Files of one model, two levels below its folder; another model's stay unread."""
    base = staging.new_path(spark, "tree")
    turns = table(spark, sf_dir, "conversations").select(
        "text",
        (F.col("conv_id") % 17 + 1).cast("int").alias("sdg_id"),
        F.col("role").alias("main_topic"),
        F.col("turn").cast("string").alias("sub_topic"),
        F.lit("plain").alias("style"),
        F.lit(40).alias("length"),
    )
    for model, rows in (("llama-3-70b", turns), ("other", turns.withColumn("style", F.lit("dense")))):
        rows.withColumn("sdg_goal", F.col("sdg_id")).hint("rebalance", "sdg_goal").write.partitionBy("sdg_goal").json(f"{base}/{model}")
    return readers.read_model_tree(spark, base)


@query("select distinct p_size as sdg_id, p_brand as main_topic, p_name as sub_topic from part")
def subtopic_catalogue(spark, sf_dir):
    """The nested catalogue as one document per goal, read back as rows."""
    path = staging.new_path(spark, "catalogue")
    parts = table(spark, sf_dir, "part").select("p_size", "p_brand", "p_name").distinct()
    topics = parts.groupBy("p_size", "p_brand").agg(F.collect_list("p_name").alias("Subtopics"))
    goals = topics.groupBy("p_size").agg(
        F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("Subtopics")))).alias("topics")
    )
    document = F.to_json(F.create_map(F.col("p_size").cast("string"), F.col("topics")))
    goals.select("p_size", document.alias("value")).repartition("p_size").write.partitionBy("p_size").text(path)
    return readers.read_subtopics(spark, f"{path}/*/*.txt")


@query("select cast(doc_id as varchar) as id, text from documents")
def resume_source(spark, sf_dir):
    """Earlier output is read if it exists, else the frame is empty."""
    path = staging.new_path(spark, "done")
    schema = "id string, text string"
    before = readers.read_if_exists(spark, path, schema)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    todo = rows.join(before.select("id"), "id", "left_anti")
    writers.write_documents(todo, path)
    return readers.read_if_exists(spark, path, schema)
