"""What the operators share: registry, Arrow passes over texts, span digests."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: White space of the word rule: blank, tab, line feed, vertical tab, form feed, return.
BLANK = " \t\n\x0b\x0c\r"


def query(name: str, sql: str | None = None):
    """Register a query."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of a frame has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def is_training(key: str | Column, held_out: int) -> Column:
    """Whether crc32 of the key as text, modulo 5, is not ``held_out``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 != held_out


def map_texts(
    df: DataFrame, keys: dict[str, str], text: str, make: Callable[[], Callable[[str], tuple]], fields: str
) -> DataFrame:
    """One output row per input row: the key columns and what a function gives for its text.

    ``keys`` maps result names to input columns. ``make`` runs once per task and
    returns the function; a null text is given as the empty text. ``fields`` is the
    schema of the function's tuple. Texts reach Python in Arrow batches that Spark
    bounds in rows and in bytes; results go back in the same batches.
    """
    columns = [F.col(f"`{c}`").alias(k) for k, c in keys.items()]
    # A text that is passed on anyway travels once.
    at = list(keys.values()).index(text) if text in keys.values() else len(keys)
    if at == len(keys):
        columns.append(F.col(f"`{text}`").alias("_text"))
    chosen = df.select(*columns)
    key_schema = StructType([chosen.schema[k] for k in keys])
    schema = StructType([*key_schema.fields, *StructType.fromDDL(fields).fields])
    n = len(keys)
    arrow = _arrow_types(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = [function(t or "") for t in batch.column(at).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *made], [*batch.schema.names[:n], *(name for name, _ in arrow)]
            )

    return chosen.mapInArrow(run, schema)


_ARROW = {
    "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64()), "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def _arrow_types(fields: str) -> list[tuple[str, pa.DataType]]:
    return [(f.name, _ARROW[f.dataType.simpleString()]) for f in StructType.fromDDL(fields).fields]


def joined_spans(spans: Iterable[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, then end, joined by commas; spans are (start, kind number, end)."""
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def sha256(value: str | Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sha2(value.cast("binary"), 256)
