"""A ledger of attempts: which prompt was sent how often, and what came of it.

The ledger is an append-only table (prompt_id, attempt, outcome, run), one folder per
run. Writing a run again replaces that folder alone, so a repeated run or micro-batch
leaves the table as it was. What is still to be sent follows from the ledger by an
anti join; prompts without an answer after the last attempt are named and not lost silently.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.text import contains_any
from labelloom.sources.readers import read_if_exists
from labelloom.sources.staging import stage

LEDGER = "prompt_id string, attempt int, outcome string, run string"
#: Outcomes: a record came of it, the model refused, or no answer arrived.
ANSWERED, REFUSED, MISSING = "answered", "refused", "missing"
MOST_ATTEMPTS = 3


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far; empty before the first run."""
    return read_if_exists(spark, path, LEDGER, "parquet").select("prompt_id", "attempt", "outcome", "run")


def outcomes(sent: DataFrame, responses: DataFrame, markers: Sequence[str] = fixed.REFUSAL_MARKERS) -> DataFrame:
    """(prompt_id, outcome) of the prompts that were sent.

    Several answers to one prompt count once, by the least message, as when they are
    ingested; an answer to a prompt that was not sent counts nothing.
    """
    once = responses.groupBy("prompt_id").agg(F.min(F.struct("message"))["message"].alias("message"), F.lit(True).alias("_found"))
    refused = F.coalesce(contains_any(F.col("message"), markers), F.lit(False))
    outcome = F.when(F.col("_found").isNull(), MISSING).when(refused, REFUSED).otherwise(ANSWERED)
    return sent.select("prompt_id").distinct().join(once, "prompt_id", "left").select("prompt_id", outcome.alias("outcome"))


def record(spark: SparkSession, path: str, run: str, found: DataFrame) -> DataFrame:
    """Write the attempts (prompt_id, outcome) of a run and return its rows.

    Runs are in the order of their names. A prompt's attempts count from 1 over the
    earlier runs, so writing a run anew gives the same numbers, whatever followed.
    """
    before = read_ledger(spark, path).filter(F.col("run") < run).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = found.join(before, "prompt_id", "left").select(
        "prompt_id", (F.coalesce("_n", F.lit(0)) + 1).cast("int").alias("attempt"), "outcome"
    )
    # Staged first: the folder of the run may be among the files that lead to its rows.
    rows = stage(rows, "attempts")
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")
    return rows.withColumn("run", F.lit(run))


def _is_done() -> Column:
    return F.col("outcome").isin(ANSWERED, REFUSED)


def open_prompts(prompts: DataFrame, ledger: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The prompts to be sent next: not answered or refused yet, and with fewer than ``most`` attempts."""
    tried = ledger.groupBy("prompt_id").agg(F.max(_is_done()).alias("_done"), F.count(F.lit(1)).alias("_n"))
    closed = tried.filter(F.col("_done") | (F.col("_n") >= most)).select("prompt_id")
    return prompts.join(closed, "prompt_id", "left_anti")


def lost_prompts(ledger: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(prompt_id, attempts) of the prompts that were given up."""
    tried = ledger.groupBy("prompt_id").agg(F.max(_is_done()).alias("_done"), F.count(F.lit(1)).alias("attempts"))
    return tried.filter(~F.col("_done") & (F.col("attempts") >= most)).select("prompt_id", "attempts")
