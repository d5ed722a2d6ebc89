"""Synthetic data: draw attributes, render prompts, ingest the answers.

Calling a model is outside: prompts go out as a table, answers come back as one.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.hashing import random_index, random_key
from labelloom.functions.text import clean_model_output
from labelloom.operators.batching import batch_number
from labelloom.operators.filters import drop_refusals
from labelloom.operators.lookup import skip_done, union_all, zip_by_key
from labelloom.operators.ranking import random_position
from labelloom.sources.staging import stage

ATTRIBUTES = ("sdg_id", "main_topic", "sub_topic", "style", "length")
DRAWS_PER_CHUNK = 10_000


# The four catalogues as one table: (kind, sdg_id, main_topic, value, number).
_GROUP = ["kind", "sdg_id", "main_topic"]


def _catalogue(subtopics: DataFrame, styles: DataFrame, lengths: DataFrame) -> DataFrame:
    """All values, numbered from 1 in their group in a fixed random order."""
    none = F.lit(None)

    def entries(df: DataFrame, kind: str, sdg_id: Column, topic: Column, value: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"),
            sdg_id.cast("bigint").alias("sdg_id"),
            topic.cast("string").alias("main_topic"),
            F.col(value).cast("string").alias("value"),
        )

    sdg_id = F.col("sdg_id")
    values = union_all(
        entries(styles, "style", none, none, "value"),
        entries(lengths, "length", none, none, "value"),
        entries(subtopics.select("sdg_id", "main_topic").distinct(), "topic", sdg_id, none, "main_topic"),
        entries(subtopics, "sub", sdg_id, F.col("main_topic"), "sub_topic"),
    ).withColumn("_key", random_key("catalogue", F.col("value")))
    return stage(random_position(values, _GROUP, "_key", "value", "number").drop("_key"), "catalogue")


def expand_plan(plan: DataFrame) -> DataFrame:
    """``draw_no`` 1..n for each planned class; classes with n = 0 yield nothing.

    The numbers are made in two steps so that a large n is spread over tasks
    instead of being one row's array. The partition count is given because the
    chunk rows are tiny and would be coalesced, while their draws are not.
    """
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.ceil(F.col("n") / DRAWS_PER_CHUNK) - 1
    others = [c for c in plan.columns if c != "n"]
    chunks = (
        plan.filter(F.col("n") > 0)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .repartition(tasks, "sdg_id", "_chunk")
    )
    first = F.col("_chunk") * DRAWS_PER_CHUNK + 1
    end = F.least(F.col("n").cast("bigint"), (F.col("_chunk") + 1) * DRAWS_PER_CHUNK)
    return chunks.select(*others, F.explode(F.sequence(first, end)).alias("draw_no"))


def draw_attributes(
    plan: DataFrame,
    subtopics: DataFrame,
    styles: DataFrame,
    lengths: DataFrame,
    seed_offset: int = fixed.CLASS_SEED_OFFSET,
) -> DataFrame:
    """Random attributes per (class, draw number), with replacement.

    A topic of the class, a sub-topic of that topic, a style and a length, each
    uniform and independent. Catalogues are numbered tables joined by number,
    so they may be of any size; the whole product is never formed.

    ``plan``: sdg_id, n. ``subtopics``: sdg_id, main_topic, sub_topic.
    ``styles`` and ``lengths``: value.
    """
    catalogue = _catalogue(subtopics, styles, lengths)
    sizes = stage(catalogue.groupBy(*_GROUP).agg(F.max("number").alias("size")), "sizes")

    def listed(table: DataFrame, kind: str, *columns: Column) -> DataFrame:
        return table.filter(F.col("kind") == kind).select(*columns)

    value, number, size = F.col("value"), F.col("number"), F.col("size")
    class_id, topic = F.col("sdg_id"), F.col("main_topic")
    # Two numbers: how many styles and how many lengths there are.
    whole = {r["kind"]: r["size"] for r in sizes.filter(F.col("kind").isin("style", "length")).collect()}
    per_class = listed(sizes, "topic", class_id, size.alias("n_topics"))
    topics = listed(
        catalogue, "topic", class_id, value.alias("main_topic"), number.alias("topic_no")
    ).join(listed(sizes, "sub", class_id, topic, size.alias("n_subs")), ["sdg_id", "main_topic"])
    subs = listed(catalogue, "sub", class_id, topic, value.alias("sub_topic"), number.alias("sub_no"))
    seed = F.col("sdg_id") + seed_offset

    def pick(choices: Column, what: str) -> Column:
        return random_index(choices, seed, F.col("draw_no"), F.lit(what))

    planned = plan.select(F.col("sdg_id").cast("bigint").alias("sdg_id"), "n")
    return (
        expand_plan(planned.join(per_class, "sdg_id"))
        .select(
            "sdg_id",
            "draw_no",
            pick(F.col("n_topics"), "topic").alias("topic_no"),
            pick(F.lit(whole["style"]), "style").alias("style_no"),
            pick(F.lit(whole["length"]), "length").alias("length_no"),
        )
        .join(topics, ["sdg_id", "topic_no"])
        .withColumn("sub_no", pick(F.col("n_subs"), "sub"))
        .join(subs, ["sdg_id", "main_topic", "sub_no"])
        .join(listed(catalogue, "style", value.alias("style"), number.alias("style_no")), "style_no")
        .join(listed(catalogue, "length", value.alias("length"), number.alias("length_no")), "length_no")
        .select(
            F.col("sdg_id").cast("int").alias("sdg_id"),
            "draw_no", "main_topic", "sub_topic", "style",
            F.col("length").cast("int").alias("length"),
        )
    )


def prompt_text(
    goal: Column, main_topic: Column, sub_topic: Column, length: Column, style: Column
) -> Column:
    """Fill the prompt template."""
    values = {
        "first": F.when(goal == fixed.NO_GOAL, F.lit(fixed.FIRST_CONDITION_NO_GOAL)).otherwise(
            _fill(fixed.FIRST_CONDITION_GOAL, {"goal": goal})
        ),
        "main_topic": main_topic,
        "sub_topic": sub_topic,
        "low": length.cast("string"),
        "high": (length.cast("int") + fixed.LENGTH_SPAN).cast("string"),
        "style": style,
    }
    return _fill(fixed.PROMPT_TEMPLATE, values)


def _fill(template: str, values: dict[str, Column]) -> Column:
    pieces = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if name:
            pieces.append(values[name])
    return F.concat(*pieces)


def as_message(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def plan_prompts(
    draws: DataFrame, goals: DataFrame, batch_size: int = fixed.BATCH_SIZE
) -> DataFrame:
    """Prompts with their ids and batches. ``goals``: sdg_id, description.

    Draw numbers count from 1 without gaps, so the batch follows from the
    number alone.
    """
    prompt = prompt_text(
        F.col("description"), F.col("main_topic"), F.col("sub_topic"), F.col("length"), F.col("style")
    )
    return draws.join(goals.select("sdg_id", "description"), "sdg_id").select(
        F.concat_ws("-", "sdg_id", "draw_no").alias("prompt_id"),
        batch_number(F.col("draw_no"), batch_size).alias("batch_id"),
        *ATTRIBUTES,
        prompt.alias("prompt"),
        as_message(prompt).alias("messages"),
    )


def ingest_responses(
    prompts: DataFrame, responses: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(records to append, prompts without an answer).

    Refusals are dropped on the raw message, then the message is cleaned. The
    unanswered prompts are to be sent again.
    """
    pairs, missing = zip_by_key(prompts, responses, "prompt_id")
    records = drop_refusals(pairs, "message").select(
        clean_model_output(F.col("message")).alias("text"), *ATTRIBUTES
    )
    return records, missing


def remaining_prompts(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    return skip_done(prompts, responses, "prompt_id")
