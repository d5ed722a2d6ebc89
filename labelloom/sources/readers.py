"""Readers. Every source has an explicit schema; formats are checked up front."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom import fixed, schemas

FORMATS = ("jsonl", "csv", "parquet")


def _struct(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


#: Rows of a part if each row is made into a whole page.
PAGES = 5_000


def spread(rows: DataFrame, key: str, size: int = PAGES) -> DataFrame:
    """The rows in parts of about ``size`` by a key that is unique or nearly so.

    For narrow rows with much work behind each: files are cut by bytes, which may leave all
    the work to one task. The number of parts follows the number of rows.
    """
    return rows.repartition(max(1, -(-rows.count() // size)), key)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _csv(spark: SparkSession, delimiter: str, multi_line: bool, **options):
    """The dialect of ``writers.write_csv``: doubled quotes, blanks kept, broken rows fail."""
    reader = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader


def _strict_csv(spark: SparkSession, path: str | list[str], delimiter: str, multi_line: bool) -> DataFrame:
    """All columns as text under the names of the header, which every file must have.

    A file with another header and a row with too many or too few fields fail the
    read. Headers are not compared where a column has no name.
    """
    names = _csv(spark, delimiter, multi_line).csv(path).columns
    named = all(name != f"_c{k}" for k, name in enumerate(names))
    texts = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return _csv(spark, delimiter, multi_line, enforceSchema=not named).schema(texts).csv(path)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: str,
    delimiter: str = ",",
    multi_line: bool = True,
) -> DataFrame:
    """Delimited text with a header; columns are taken by name and cast.

    Texts may hold quoted line feeds, which makes a file one task: keep the
    files moderate, or pass ``multi_line=False`` for files without them.
    """
    raw = _strict_csv(spark, path, delimiter, multi_line)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in _struct(schema)])


def read_data(
    spark: SparkSession, path: str, schema: str, format: str = "jsonl", **options
) -> DataFrame:
    """Read one source; an unknown format is a ``TypeError``."""
    if format not in FORMATS:
        raise TypeError(f"unknown format {format!r}, expected one of {FORMATS}")
    if format == "jsonl":
        return read_jsonl(spark, path, schema, **options)
    if format == "csv":
        return read_csv(spark, path, schema, **options)
    return spark.read.schema(schema).parquet(path)


def read_model_tree(
    spark: SparkSession, base: str, model: str = "llama-3-70b", files: str = "*.json*"
) -> DataFrame:
    """All JSON-lines files two levels below one model's folder."""
    return read_jsonl(spark, f"{base.rstrip('/')}/{model}/*/{files}", schemas.SYNTHETIC)


def read_generated(spark: SparkSession, base: str, model: str | None = None) -> DataFrame:
    """Records written by ``writers.append_generated``; one model prunes folders."""
    records = spark.read.schema(
        schemas.SYNTHETIC + ", model string, sdg_goal int, run_ts string"
    ).json(base)
    return records if model is None else records.filter(F.col("model") == model)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One string ``value`` per line."""
    return spark.read.text(path)


def read_subtopics(spark: SparkSession, path: str) -> DataFrame:
    """The nested topic catalogue as rows (sdg_id, main_topic, sub_topic).

    A document is one value, since it is one nested map. A large catalogue is kept as
    many documents, one per goal, say: each file is a row of its own.
    """
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", schemas.SUBTOPICS, {"mode": "FAILFAST"}).alias("goals")
    )
    topics = document.select(F.explode("goals").alias("sdg_id", "topics")).select(
        F.col("sdg_id").cast("int").alias("sdg_id"),
        F.explode("topics").alias("main_topic", "entry"),
    )
    return topics.select("sdg_id", "main_topic", F.explode("entry.Subtopics").alias("sub_topic"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A document id -> {header: value} as rows (id, meta)."""
    document = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "map<string, map<string, string>>", {"mode": "FAILFAST"}).alias("papers")
    )
    return document.select(F.explode("papers").alias("id", "meta"))


def header_table(spark: SparkSession, path: str, excluded: Sequence[str] = ()) -> DataFrame:
    """(file, header): the first line of every CSV file whose name holds none of the excluded words.

    Files without a line have no row. Only the first block of a file is read.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"),
    )
    for word in excluded:
        lines = lines.filter(~F.contains("_name", F.lit(word)))
    first = lines.filter(F.col("_start") == 0).groupBy("file").agg(F.min_by("value", "_at").alias("header"))
    return first


def read_topic_files(
    spark: SparkSession,
    folder: str,
    schema: str = schemas.NULL_CLASS_TOPIC,
    excluded: Sequence[str] = fixed.EXCLUDED_FILE_MARKERS,
) -> DataFrame:
    """All CSV files of a folder whose names hold none of the excluded words, their columns by name.

    Files may have their columns in any order, and further columns, such as the index
    column without a name. The driver gets one line per file, its header; files with one header
    are one scan. A file that lacks a column is an error. The condition on the file
    name skips the files themselves. Write results to another folder, or the next run reads
    them again.
    """
    path = f"{folder.rstrip('/')}/*.csv"
    fields = [f for f in _struct(schema).fields if not f.name.startswith("_c")]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in header_table(spark, path, excluded).collect():
        line = (row["header"] or "").removeprefix("\ufeff")
        names = tuple(n or f"_c{k}" for k, n in enumerate(next(csv.reader([line]), [])))
        if missing := [f.name for f in fields if f.name not in names]:
            raise ValueError(f"{row['file']} has no column {', '.join(missing)}")
        if len(set(names)) < len(names):
            raise ValueError(f"{row['file']} has two columns of one name")
        layouts.setdefault(names, []).append(row["file"])
    parts = []
    for names, files in sorted(layouts.items()):
        texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = _csv(spark, ",", True, enforceSchema=True).schema(texts).csv(path)
        raw = raw.filter(F.col("_metadata.file_path").isin(files))
        parts.append(raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields]))
    if not parts:
        return spark.createDataFrame([], T.StructType(fields))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def read_if_exists(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """Earlier output, or an empty frame of the same schema."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_cleaned(spark: SparkSession, path: str, empty_text: bool = True) -> DataFrame:
    """A cleaned corpus; text that cleaned to nothing comes back null.

    ``empty_text`` turns it into an empty string, otherwise the row is dropped.
    """
    rows = read_csv(spark, path, schemas.CLEANED, multi_line=False)
    if empty_text:
        return rows.withColumn("text_clean", F.coalesce("text_clean", F.lit("")))
    return rows.filter(F.col("text_clean").isNotNull())


def read_splits(
    spark: SparkSession, files: dict[str, str], schema: str, multi_line: bool = False
) -> DataFrame:
    """Several CSV sources as one frame with a ``split`` column; cleaned texts have no line feeds."""
    parts = [
        read_csv(spark, path, schema, multi_line=multi_line).withColumn("split", F.lit(name))
        for name, path in files.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
