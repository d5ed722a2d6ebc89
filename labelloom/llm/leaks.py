"""Benchmark decontamination by templates.

Numbers, units and names are replaced by typed placeholders, so that a benchmark
question with other values still has the same template. Windows of template words are
joined by hash with those of the benchmark. Matches that lie on one diagonal are put
together, and the values in their slots must correspond one to one: the same value of
the question always stands for the same value in the document, and the other way round.

Everything is DataFrame functions. The benchmark's windows are written once, so the
planner knows their size and broadcasts them only below its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import free_name, query, table
from labelloom.sources.staging import stage

#: Words in a window; items with fewer words are one window, those under ``LEAST_WINDOW`` whole texts.
WINDOW, LEAST_WINDOW = 8, 4
#: Words of an item that must be found on one diagonal, or all if it has fewer.
LEAST_WORDS = 13
#: Windows with fewer words outside slots must have equal values in them.
LEAST_LITERALS = 4
#: Units that may follow a number (fixed values).
UNITS = (
    "%|°C|°F|kg|mg|g|km|cm|mm|m|ml|l|lb|oz|ft|mph|hours?|minutes?|seconds?|days?|weeks?|months?|years?|hrs?|mins?|secs?"
    "|dollars?|euros?|pounds?|cents?|meters?|metres?|kilometers?|miles?|inches|feet|liters?|litres?|grams?|kilograms?|percent"
)
UNIT, NUMBER, NAME, JOINT = "\x02", "\x03", "\x04", "\x05"


#: Which words are names: all capitalised ones; these without the first words of sentences; these and
#: all first words of sentences; none. Documents are read the first way, items in all of them.
READINGS = ("capitalised", "within", "beginnings", "none")
_CAPITALISED, _WITHIN = r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)", r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
_BEGINNING = r"((?:^|[.?!][\"')]*\s+)[\"'(]*)(\p{Ll}+)"


def valued(text: Column, reading: str = "capitalised") -> Column:
    """Template of a text with its values: lower-case words, one blank apart.

    A slot is a word that begins with the sign of its type and goes on with its value.
    What a word is depends on the word, not on the text around it, so a passage has the
    same template wherever it is quoted. Items are read in further ways, see ``READINGS``, for quotations
    that differ from them in the case of first words or of all words.
    """
    text = F.translate(F.coalesce(text, F.lit("")), UNIT + NUMBER + NAME + JOINT, "    ")
    joined = F.regexp_replace(
        F.regexp_replace(
            F.regexp_replace(text, rf"(?<=[0-9])\s?({UNITS})(?![\p{{L}}\p{{N}}])", f" {UNIT}$1 "),
            r"([$€£¥])(?=\s?[0-9])", f" {UNIT} ",
        ),
        r"(?<=[0-9])[.,:/-](?=[0-9])", JOINT,
    )
    numbers = F.regexp_replace(joined, rf"[0-9][0-9{JOINT}]*", f" {NUMBER}$0 ")
    text = F.when(text.rlike("[0-9]"), numbers).otherwise(text)
    if reading == "beginnings":
        text = F.regexp_replace(text, _BEGINNING, f"$1{NAME}$2")
    if reading != "none":
        text = F.regexp_replace(text, _WITHIN if reading == "within" else _CAPITALISED, f"{NAME}$1")
    return F.trim(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}{UNIT}-{JOINT}]+", " "))


def template(values: Column) -> Column:
    """Template without the values in its slots."""
    return F.regexp_replace(values, rf"([{UNIT}-{NAME}])[^ ]*", "$1")


def window_texts(values: Column, size: int) -> Column:
    """All windows of so many template words, in order."""
    return F.regexp_extract_all(template(values), F.lit(rf"(?=([^ ]+(?: [^ ]+){{{size - 1}}}(?![^ ])))[^ ]+"), F.lit(1))


def items_of(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Templates of the items in every reading, with a number for each and its words.

    Equal templates with equal values are kept once under the smallest id. A null text
    has no words.
    """
    texts = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("_text"))
    readings = F.explode(F.array_distinct(F.array(*[valued(F.col("_text"), r) for r in READINGS])))
    rows = texts.select("item", readings.alias("values")).filter(F.col("values") != "")
    return rows.groupBy("values").agg(F.min("item").alias("item")).select(
        "item", "values", F.xxhash64("values").alias("variant"), F.size(F.split("values", " ")).alias("n_item")
    )


def item_windows(items: DataFrame) -> DataFrame:
    """Hashes of the windows of the items that are long enough, with their places."""
    size = F.least(F.lit(WINDOW), "n_item")
    windows = F.when(F.col("n_item") >= WINDOW, window_texts(F.col("values"), WINDOW)).otherwise(F.array(template(F.col("values"))))
    long = items.filter(F.col("n_item") >= LEAST_WINDOW)
    return long.select("item", "variant", "n_item", size.alias("size"), F.posexplode(windows).alias("item_at", "window")).select(
        F.xxhash64("window").alias("hash"), "size", "item", "variant", "item_at", "n_item"
    )


def whole_texts(df: DataFrame, items: DataFrame, key: str, text: str) -> DataFrame:
    """Documents that are nothing but an item too short for a window: key, item, words, slots, changed slots.

    Every run of letters is in a word of its own, so a text with more of them than a
    short item has words is told by its beginning.
    """
    letters = r"\p{L}+[^\p{L}]+" * (LEAST_WINDOW - 1) + r"\p{L}"
    brief = df.filter(F.coalesce(~F.col(f"`{text}`").rlike(letters), F.lit(False)))
    brief = brief.select(F.col(f"`{key}`").alias("key"), valued(F.col(f"`{text}`")).alias("values"))
    slots = F.size(F.filter(F.split("values", " "), lambda w: w.rlike(f"^[{UNIT}-{NAME}]")))
    short = items.filter(F.col("n_item") < LEAST_WINDOW)
    return brief.join(short, "values").select(
        "key", "item", F.col("n_item").cast("long").alias("n_words"), slots.cast("long").alias("n_slots"), F.lit(0).cast("long").alias("n_changed")
    )


def find_leaks(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Documents that hold a benchmark item: key, item, words found, slots, slots with another value.

    An item of fewer than ``LEAST_WINDOW`` words is found where it is the whole text. A pair
    is returned once, for its best reading and diagonal: the one with the most words, then the fewest
    changed slots, then the fewest slots. Rows with one key and different texts
    are judged each; repeated rows give one result. Null texts hold nothing; a null key
    is a key. Empty tables give no rows. Other columns are left out.
    """
    items = stage(items_of(benchmark, item, item_text), "benchmark-items")
    hashes = stage(item_windows(items), "benchmark-windows")
    docs = df.select(F.col(f"`{key}`").alias("key"), valued(F.col(f"`{text}`")).alias("values"))
    sizes = [r["size"] for r in hashes.select("size").distinct().collect()]  # WINDOW and less: a few numbers
    parts = []
    for size in sorted(sizes) or [WINDOW]:
        windows = docs.select(
            "key", F.xxhash64("values").alias("text_hash"), F.posexplode(window_texts(F.col("values"), size)).alias("at", "window")
        ).select("key", "text_hash", "at", F.xxhash64("window").alias("hash"))
        parts.append(windows.join(hashes.filter(F.col("size") == size), "hash"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # Words of the item found on each diagonal; an item bounds its number of rows.
    diagonals = (
        found.groupBy("key", "text_hash", "item", "variant", "n_item", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.collect_set(F.struct("item_at", "size")).alias("windows"))
        .withColumn(
            "words",
            F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["item_at"], w["item_at"] + w["size"] - 1)))),
        )
        .filter(F.size("words") >= F.least(F.lit(LEAST_WORDS), "n_item"))
        .select("key", "text_hash", "item", "variant", "shift", "words")
    )
    diagonals = stage(diagonals, "leak-diagonals")
    # Only documents with a candidate are read again, for the values in their slots.
    texts = docs.withColumn("text_hash", F.xxhash64("values")).dropDuplicates(["key", "text_hash"])
    candidates = diagonals.select("key", "text_hash").distinct()
    texts = (
        texts.alias("t")
        .join(candidates.alias("c"), F.col("t.key").eqNullSafe(F.col("c.key")) & (F.col("t.text_hash") == F.col("c.text_hash")), "left_semi")
        .select(F.col("t.key").alias("key"), F.col("t.text_hash").alias("text_hash"), F.split("t.values", " ").alias("doc_words"))
    )
    both = (
        diagonals.alias("d")
        .join(texts.alias("t"), F.col("d.key").eqNullSafe(F.col("t.key")) & (F.col("d.text_hash") == F.col("t.text_hash")))
        .join(items.select("variant", F.split("values", " ").alias("item_words")).alias("i"), F.col("d.variant") == F.col("i.variant"))
        .select("d.key", "d.item", "d.shift", "d.words", "t.doc_words", "i.item_words")
    )
    pairs = F.transform(
        "words", lambda k: F.struct(F.get("item_words", k).alias("i"), F.get("doc_words", k + F.col("shift")).alias("d"))
    )
    slots = F.filter(F.col("pairs"), lambda p: p["i"].rlike(f"^[{UNIT}-{NAME}]"))
    distinct = F.array_distinct("slots")
    one_to_one = (F.size(F.array_distinct(F.transform(distinct, lambda p: p["i"]))) == F.size(distinct)) & (
        F.size(F.array_distinct(F.transform(distinct, lambda p: p["d"]))) == F.size(distinct)
    )
    changed = F.size(F.filter("slots", lambda p: p["i"] != p["d"]))
    few = F.size("words") - F.size("slots") < LEAST_LITERALS
    judged = (
        both.withColumn("pairs", pairs)
        .withColumn("slots", slots)
        .withColumn("n_changed", changed.cast("long"))
        .filter(one_to_one & (~few | (F.col("n_changed") == 0)))
    )
    counted = judged.select(
        "key", "item", F.size("words").cast("long").alias("n_words"), F.size("slots").cast("long").alias("n_slots"), "n_changed"
    ).unionByName(whole_texts(df, items, key, text))
    best = F.max(F.struct("n_words", -F.col("n_changed"), -F.col("n_slots"))).alias("b")
    return counted.groupBy("key", "item").agg(best).select(
        "key", "item", "b.n_words", (-F.col("b.col3")).alias("n_slots"), (-F.col("b.col2")).alias("n_changed")
    )


def drop_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key has no leak, with all their columns.

    Documents with null or empty texts stay, as do repeated rows of a clean document; all rows of a key
    with a leak go, a null key being a key. Without items every document stays. Columns may
    have any names.
    """
    leaked = free_name(df, "_leaked")
    found = stage(find_leaks(df, benchmark, key, text).select(F.col("key").alias(leaked)).distinct(), "leaked")
    return df.join(found, F.col(f"`{key}`").eqNullSafe(F.col(leaked)), "left_anti")


@query("op5_leaks")
def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"key": "doc_id", "item": "item_id"})
