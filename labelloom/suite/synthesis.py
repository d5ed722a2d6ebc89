"""Synthetic data: draws, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.operators.lookup import unique_mapping
from labelloom.plans import attempts, synthesis
from labelloom.sources import staging
from labelloom.suite.registry import query, quoted, sql_key, sql_random, table

# Part sizes stand for classes, brands for topics, part names for sub-topics,
# part types for styles; a class is planned as often as it has parts.


def _draws(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    plan = parts.groupBy(F.col("p_size").alias("sdg_id")).agg(F.count(F.lit(1)).alias("n"))
    subtopics = parts.select(
        F.col("p_size").alias("sdg_id"),
        F.col("p_brand").alias("main_topic"),
        F.col("p_name").alias("sub_topic"),
    )
    styles = parts.select(F.col("p_type").alias("value")).distinct()
    lengths = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") * 20 + 40).cast("string").alias("value")
    )
    return synthesis.draw_attributes(plan, subtopics, styles, lengths)


def _goals(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    named = parts.select(
        F.col("p_size").alias("sdg_id"),
        F.when(F.col("p_size") == 1, fixed.NO_GOAL).otherwise(F.col("p_name")).alias("description"),
    )
    return unique_mapping(named, "sdg_id", "description")


def _prompts(spark, sf_dir):
    return synthesis.plan_prompts(_draws(spark, sf_dir), _goals(spark, sf_dir))


def _numbered(value: str) -> str:
    return f"order by {sql_key('catalogue', value)}, {value}"


def _pick(size: str, what: str) -> str:
    return f"({sql_random('(sdg_id + 1234)', 'draw_no', quoted([what]))} % {size} + 1)"


_DRAWS = f"""
    subs as (select p_size as sdg_id, p_brand as main_topic, p_name as sub_topic,
      row_number() over (partition by p_size, p_brand {_numbered('p_name')}) as sub_no from part),
    topics as (select sdg_id, main_topic, n_subs,
      row_number() over (partition by sdg_id {_numbered('main_topic')}) as topic_no,
      count(*) over (partition by sdg_id) as n_topics
      from (select sdg_id, main_topic, count(*) as n_subs from subs group by 1, 2)),
    styles as (select style, row_number() over ({_numbered('style')}) as style_no
      from (select distinct p_type as style from part)),
    lengths as (select length, row_number() over ({_numbered('length')}) as length_no
      from (select cast(n_nationkey * 20 + 40 as varchar) as length from nation)),
    sizes as (select (select count(*) from styles) as n_styles, (select count(*) from lengths) as n_lengths),
    planned as (select sdg_id, unnest(range(1, n + 1)) as draw_no
      from (select p_size as sdg_id, count(*) as n from part group by 1)),
    draws as (select p.sdg_id, draw_no, t.main_topic, sub_topic, style, cast(length as integer) as length
      from planned p cross join sizes
      join (select distinct sdg_id as c_id, n_topics as c_n from topics) on c_id = p.sdg_id
      join topics t on t.sdg_id = p.sdg_id and topic_no = {_pick('c_n', 'topic').replace('sdg_id', 'p.sdg_id')}
      join subs s on s.sdg_id = p.sdg_id and s.main_topic = t.main_topic
        and sub_no = {_pick('n_subs', 'sub').replace('sdg_id', 'p.sdg_id')}
      join styles on style_no = {_pick('n_styles', 'style').replace('sdg_id', 'p.sdg_id')}
      join lengths on length_no = {_pick('n_lengths', 'length').replace('sdg_id', 'p.sdg_id')})"""


def _sql_prompt() -> str:
    """The template as SQL concatenation."""
    first = (
        f"case when description = '{fixed.NO_GOAL}' then {quoted([fixed.FIRST_CONDITION_NO_GOAL])}"
        f" else replace({quoted([fixed.FIRST_CONDITION_GOAL])}, '{{goal}}', description) end"
    )
    result = quoted([fixed.PROMPT_TEMPLATE])
    for name, value in {
        "{first}": first,
        "{main_topic}": "main_topic",
        "{sub_topic}": "sub_topic",
        "{low}": "cast(length as varchar)",
        "{high}": "cast(length + 60 as varchar)",
        "{style}": "style",
    }.items():
        result = f"replace({result}, '{name}', {value})"
    return result


_PROMPTS = f"""{_DRAWS},
    goals as (select p_size as goal_id, min(case when p_size = 1 then '{fixed.NO_GOAL}' else p_name end)
      as description from part group by 1),
    prompts as (select sdg_id || '-' || draw_no as prompt_id, cast((draw_no - 1) // 20 as bigint) as batch_id,
      sdg_id, main_topic, sub_topic, style, length, {_sql_prompt()} as prompt
      from draws join goals on sdg_id = goal_id)"""


@query(f"with {_DRAWS} select * from draws")
def attribute_draws(spark, sf_dir):
    return _draws(spark, sf_dir)


@query(
    f"""with {_PROMPTS} select *, '[{{"role":"user","content":' || to_json(prompt) || '}}]' as messages
    from prompts"""
)
def prompts(spark, sf_dir):
    return _prompts(spark, sf_dir).withColumn("messages", F.to_json("messages"))


# Conversations answer the prompts that carry their number.
_ANSWERS = """answers as (select (conv_id % 50 + 1) || '-' || (turn + 1) as prompt_id,
      min(text) as message from conversations group by 1)"""


def _answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy(
        F.concat_ws("-", (F.col("conv_id") % 50 + 1).cast("string"), (F.col("turn") + 1).cast("string")).alias(
            "prompt_id"
        )
    ).agg(F.min("text").alias("message"))


@query(
    f"""with {_PROMPTS}, {_ANSWERS}
    select trim(regexp_replace(regexp_replace(case when len(string_split(message, 'Abstract')) = 2
        then string_split(message, 'Abstract')[2] else message end,
        '[^A-Za-z0-9(),.:!?"'']', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) as text,
      sdg_id, main_topic, sub_topic, style, length
    from prompts join answers using (prompt_id)
    where not (contains(message, 'I apologize') or contains(message, 'sorry')
      or contains(message, 'an AI language model'))"""
)
def ingest_responses(spark, sf_dir):
    records, _ = synthesis.ingest_responses(_prompts(spark, sf_dir), _answers(spark, sf_dir))
    return records


@query(f"with {_PROMPTS}, {_ANSWERS} select prompt_id from prompts where prompt_id not in (select prompt_id from answers)")
def missing_responses(spark, sf_dir):
    _, missing = synthesis.ingest_responses(_prompts(spark, sf_dir), _answers(spark, sf_dir))
    return missing.select("prompt_id")


# --- three rounds of partial answers: customers stand for prompts ------------------------------

#: Per round the divisor of the keys that are answered and of those that are refused.
_ROUNDS = ((3, 4), (5, 7), (2, 11))
_LEDGER = """prompts as (select cast(c_custkey as varchar) as prompt_id, c_custkey as k from customer),
    round_1 as (select *, case when k % 4 = 0 then 'refused' when k % 3 = 0 then 'answered' else 'missing' end as outcome from prompts),
    round_2 as (select prompt_id, k, case when k % 7 = 0 then 'refused' when k % 5 = 0 then 'answered' else 'missing' end as outcome
      from round_1 where outcome = 'missing'),
    round_3 as (select prompt_id, k, case when k % 11 = 0 then 'refused' when k % 2 = 0 then 'answered' else 'missing' end as outcome
      from round_2 where outcome = 'missing'),
    ledger as (select prompt_id, 1 as attempt, outcome, 'run-1' as run from round_1
      union all select prompt_id, 2, outcome, 'run-2' from round_2 union all select prompt_id, 3, outcome, 'run-3' from round_3)"""


def _rounds(spark, sf_dir, last=3):
    """A ledger after some rounds, the second of which is written twice."""
    path = staging.new_path(spark, "ledger")
    prompts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("prompt_id"), F.col("c_custkey").alias("k"))
    for number, (answered, refused) in enumerate(_ROUNDS[:last], 1):
        sent = staging.stage(attempts.open_prompts(prompts, attempts.read_ledger(spark, path)), "sent")
        said = F.when(F.col("k") % refused == 0, "sorry, no").when(F.col("k") % answered == 0, "an abstract")
        responses = sent.select("prompt_id", said.alias("message")).filter(F.col("message").isNotNull())
        found = attempts.outcomes(sent, responses)
        for _ in range(2 if number == 2 else 1):
            attempts.record(spark, path, f"run-{number}", found)
    return prompts, attempts.read_ledger(spark, path)


@query(f"with {_LEDGER} select * from ledger")
def attempt_ledger(spark, sf_dir):
    """All attempts of three rounds; a repeated run leaves no second row."""
    return _rounds(spark, sf_dir)[1]


@query(f"with {_LEDGER} select prompt_id, k from round_2 where outcome = 'missing'")
def open_prompts(spark, sf_dir):
    """What the third round sends."""
    return attempts.open_prompts(*_rounds(spark, sf_dir, last=2))


@query(f"with {_LEDGER} select prompt_id, cast(3 as bigint) as attempts from round_3 where outcome = 'missing'")
def lost_prompts(spark, sf_dir):
    return attempts.lost_prompts(_rounds(spark, sf_dir)[1])
