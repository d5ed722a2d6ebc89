"""Time the registered queries; prints one JSON line.

The tables are first written again in ``FILES`` files each, as tables of a cluster are, so
that their scans use all cores; that is not part of the times. Every query runs once to
warm up and then ``BENCH_RUNS`` times; the median counts. A run builds the plan and
evaluates the whole result without keeping it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from labelloom.suite import QUERIES  # noqa: E402

HEADLINE = (
    "process_text", "process_pages", "alpha_tokens", "strip_html_urls", "clean_model_output",
    "marker_flag", "detect_language", "detect_language_report", "language_profiles",
    "detect_learned", "prepare_corpus", "prepare_full_corpus", "dedup_rows", "dedup_texts",
    "null_class_corpus", "stratified_split", "rule_based_split", "three_way_split",
    "exact_half_split", "one_per_group", "topk_per_topic", "shuffle_rows", "batches",
    "attribute_draws", "prompts", "ingest_responses", "lookup_join", "first_match_join",
    "suffix_skip", "plan_vs_actual", "group_lines", "distinct_lines", "path_tree",
    "papers_per_category", "forward_fill", "group_indicators", "html_metadata",
    "html_table_rows", "weighted_f1", "argmax", "label_words", "json_fields",
    "corpus_round_trip", "generated_round_trip", "classify", "lemma_table", "nested_lists",
    "tree_documents", "three_way_exact_split", "target_pages", "detect_open_set",
    "abbreviation_scores", "learned_tokens", "apply_lemmas", "sample_per_group",
    "attempt_ledger", "mapped_splits", "topic_files", "batch_numbers",
)


FILES = 16


def spread(spark: SparkSession, sf_dir: str) -> str:
    """The tables of a folder in ``FILES`` files each, in a new folder."""
    out = tempfile.mkdtemp(prefix="labelloom-bench-")
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{file}").repartition(FILES).write.parquet(f"{out}/{file}")
    return out


def run(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("labelloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, tables = {}, spread(spark, sf_dir)
    for name in names:
        run(spark, name, tables)
        seconds[name] = round(statistics.median(run(spark, name, tables) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    version = spark.version
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "files": FILES,
                "runs": runs,
                "spark": version,
            }
        )
    )


if __name__ == "__main__":
    main()
