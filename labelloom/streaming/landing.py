"""Landed files as they arrive: append mode and resume with Structured Streaming.

The stream's checkpoint remembers which files were taken, so a restarted run
skips what is done. There is no windowing and no state besides that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom import schemas
from labelloom.plans import attempts
from labelloom.plans.synthesis import ingest_responses
from labelloom.sources.staging import stage
from labelloom.sources.writers import append_generated


def landed_responses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.RESPONSES).json(folder)


def ingest_landed(
    spark: SparkSession, prompts: DataFrame, landed: str, out: str, model: str, checkpoint: str,
    ledger: str | None = None,
) -> StreamingQuery:
    """Take the answer files landed since the last run and append their records.

    Each micro-batch is one run; its time stamp is its number, so a batch that
    is repeated after a failure replaces its own folder instead of adding to it.
    The prompts are staged once, so no micro-batch draws and renders them again.

    With the path of a ledger every micro-batch records the outcome of the prompts it
    answers, under its number too. Prompts without an answer are recorded when a round
    is closed, see ``close_round``.
    """
    prompts = stage(prompts, "prompts")

    def append(batch: DataFrame, number: int) -> None:
        records, _ = ingest_responses(prompts, batch)
        append_generated(records, out, model, f"batch-{number:08d}", replace_run=True)
        if ledger is not None:
            answered = prompts.join(batch.select("prompt_id").distinct(), "prompt_id", "left_semi")
            attempts.record(spark, ledger, f"batch-{number:08d}", attempts.outcomes(answered, batch))

    return (
        landed_responses(spark, landed)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close_round(spark: SparkSession, sent: DataFrame, ledger: str, run: str, since: str = "") -> DataFrame:
    """Record a missing answer for every prompt that was sent and has no row in the runs after ``since``.

    ``run`` has to come behind the runs of the round in the order of their names, as
    ``batch-00000007-end`` does behind ``batch-00000007``.
    """
    rows = attempts.read_ledger(spark, ledger)
    heard = rows.filter((rows["run"] > since) & (rows["run"] < run)).select("prompt_id")
    unheard = sent.select("prompt_id").distinct().join(heard, "prompt_id", "left_anti")
    return attempts.record(spark, ledger, run, unheard.withColumn("outcome", F.lit(attempts.MISSING)))
