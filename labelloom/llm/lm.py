"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. Every decision has a context tree over the
bytes before it; a node holds the Krichevsky-Trofimov estimate of its zeros and ones, and
the estimates of all depths are mixed with the weights that the training texts give them.

The model is a staged table that grows with the text. Counts of (context, byte) are summed
up for all texts; those that only held-out texts have count zero, so that every byte that
is ever scored is in the table. The trees are cut ``SPLIT`` bytes deep: what lies below is
one part for each context of that length, worked on in numpy by tasks that get whole parts
(at most ``256 ** (DEPTH - SPLIT + 1)`` rows each, whatever the input); what lies above is
grouped and joined on the context without its oldest byte, one depth after the other.
The code lengths of bytes in context that make up at least ``1 / HOT_GRAMS`` of all are looked
up in a table sent to all tasks; all others are counted within a text and joined.

The unigram base score needs the count of every word. Words that make up at least
``1 / HOT`` of all tokens (so at most ``HOT`` of them) are looked up in a table sent to
all tasks; all others are joined, so that no word brings many rows to one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from labelloom.llm.common import is_training, query, table
from labelloom.sources.staging import stage

#: Bytes of context.
DEPTH = 5
#: Bytes of context at which the trees are cut into parts.
SPLIT = 3
#: Byte that UTF-8 never uses: it stands before a text and ends it.
EDGE = 255
#: Most words that are looked up in a table sent to all tasks.
HOT = 1 << 18
#: Most bytes in context whose code lengths are looked up in a table sent to all tasks.
HOT_GRAMS = 1 << 21
#: Rows with ``crc32 % 5`` equal to this are held out.
HELD_OUT = 1
#: Distinct words a task gathers before it passes their counts on.
GATHERED = 500_000
#: Bytes of texts handled at once.
BLOCK = 1 << 20
#: Distinct bytes in context a task gathers before it passes their counts on, and rows of the trees it handles at once.
GATHERED_GRAMS, TREE_ROWS = 1 << 20, 1 << 15


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode().lower()


def grams(raw: bytes, depth: int) -> np.ndarray:
    """Context and byte of every position as one number; edges stand before and after the text."""
    x = np.frombuffer(bytes([EDGE]) * depth + raw + bytes([EDGE]), np.uint8).astype(np.int64)
    out = np.zeros(len(raw) + 1, np.int64)
    for d in range(depth + 1):
        out = (out << 8) | x[d : d + len(out)]
    return out


# --- training ------------------------------------------------------------------------


def gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """Counts of context and byte over texts, ``n`` in those not held out and ``times`` in all; tasks sum up their own rows first."""
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, runs = ([], []), 0, []

        def counted():
            for held, parts in enumerate(waiting):
                if parts:
                    found, times = np.unique(np.concatenate(parts), return_counts=True)
                    runs.append((found, times * (1 - held), times))
                    parts.clear()

        def merged():
            if len(runs) > 1:
                keys, n, times = (np.concatenate(x) for x in zip(*runs))
                every, where = np.unique(keys, return_inverse=True)
                runs[:] = [(every, *(np.bincount(where, x, len(every)).astype(np.int64) for x in (n, times)))]

        def flushed():
            for keys, n, times in runs:
                for at in range(0, len(keys), 100_000):
                    own = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(n[own]), pa.array(times[own])], schema=schema)
            runs.clear()

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting[held].append(grams(lowered(text), depth))
                size += len(waiting[held][-1])
                if size >= BLOCK:
                    counted()
                    size = 0
                    if sum(len(r[0]) for r in runs) >= GATHERED_GRAMS:
                        merged()
                        if sum(len(r[0]) for r in runs) >= GATHERED_GRAMS // 2:
                            yield from flushed()
        counted()
        merged()
        yield from flushed()

    counts = docs.select("_text", "held_out").mapInArrow(run, "gram long, n long, times long")
    return counts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a block of zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5, by Stirling's series after shifting x up."""
    x = np.asarray(x, np.float64)
    y, shift = x.copy(), np.zeros_like(x)
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decision nodes of rows of byte counts; node 1 is the first bit."""
    sums = np.zeros((len(counts), 512))
    sums[:, 256:] = counts
    for node in range(255, 0, -1):
        sums[:, node] = sums[:, 2 * node] + sums[:, 2 * node + 1]
    return sums[:, 2:512:2], sums[:, 3:512:2]  # column k belongs to node k + 1


# A decision's place at a depth is one number: its context, and its node (1 to 255) in the last byte.


def _above(places, depth: int):
    """Places of the same decisions in the context without its oldest byte, from ``depth`` bytes."""
    return (places & ((1 << 8 * depth) - 1 & -256)) | (places & 255) if depth else places


def _weighted(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted log-probability, weight of the own estimate, own estimate of a one; ``below`` is None at full depth."""
    log_kt = _log_kt(zeros, ones)
    log_weighted = log_kt if below is None else np.logaddexp(log_kt, below) - math.log(2)
    share = np.ones_like(log_kt) if below is None else np.exp(log_kt - math.log(2) - log_weighted)
    return log_weighted, share, (ones + 0.5) / (zeros + ones + 1)


def _bits(keys: np.ndarray) -> np.ndarray:
    return (keys[:, None] >> np.arange(7, -1, -1)) & 1


def subtrees(keys: np.ndarray, counts: np.ndarray, top: int, depth: int) -> tuple[list[tuple], tuple, np.ndarray]:
    """Trees from ``top`` to ``depth`` bytes of context.

    Gives (places, weight of the own estimate, own estimate of a one) of each depth from the
    top, (zeros, ones, weighted log-probability) at the top, and where the eight decisions
    of every key are at full depth.
    """
    bits = _bits(keys)
    nodes = (1 << np.arange(8)) | ((keys & 255)[:, None] >> np.arange(8, 0, -1))
    own = ((keys & ((1 << 8 * (depth + 1)) - 1 & -256))[:, None] | nodes).ravel()
    places, deepest = np.unique(own, return_inverse=True)
    deepest = deepest.ravel()
    ones = np.bincount(deepest, (bits * counts[:, None]).ravel(), len(places))
    zeros = np.bincount(deepest, ((1 - bits) * counts[:, None]).ravel(), len(places))
    below, levels = None, []
    for d in range(depth, top - 1, -1):
        log_weighted, share, estimate = _weighted(zeros, ones, below)
        levels.append((places, share, estimate))
        if d > top:
            upper, where = np.unique(_above(places, d), return_inverse=True)
            below = np.bincount(where, log_weighted, len(upper))
            zeros, ones_ = np.bincount(where, zeros, len(upper)), np.bincount(where, ones, len(upper))
            places, ones = upper, ones_
    return levels[::-1], (zeros, ones, log_weighted), deepest


def _mixed(levels: list[tuple], top: int, settled: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, what they and shorter contexts have settled, and what is left to longer ones, of each depth from the top."""
    above = None
    for d, (places, share, estimate) in enumerate(levels, top):
        if above is not None:
            at = np.searchsorted(above, _above(places, d))
            settled, left = settled[at], left[at]
        settled, left = settled + left * share * estimate, left * (1 - share)
        above = places
        yield places, settled, left


class SparseTable:
    """log10 probabilities of bytes in context, by the decisions that occur; indexed with context and byte."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        levels, _, _ = subtrees(keys, counts, 0, depth)
        n = len(levels[0][0])
        self.levels = [(places, settled + left * 0.5) for places, settled, left in _mixed(levels, 0, np.zeros(n), np.ones(n))]

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.int64)
        nodes = (1 << np.arange(8)) | ((keys & 255)[:, None] >> np.arange(8, 0, -1))
        ones = np.full(nodes.shape, 0.5)
        for d, (places, one) in enumerate(self.levels):
            own = (keys & ((1 << 8 * (d + 1)) - 1 & -256))[:, None] | nodes
            at = np.minimum(np.searchsorted(places, own), max(len(places) - 1, 0))
            if len(places):
                ones = np.where(places[at] == own, one[at], ones)
        return np.where(_bits(keys) == 1, np.log10(ones), np.log10(1 - ones)).sum(axis=1)


def code_table(keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray | SparseTable:
    """log10 probability of every byte after every context, from the training counts.

    The plain form in memory: an array of 256 ** (depth + 1) cells up to depth 2, beyond that a table of what occurs.

    Goes up from the longest contexts to get the weights, then down to mix. Works on the
    contexts that occur; all others share what their shorter context gives.
    """
    if depth > 2:
        return SparseTable(keys, counts, depth)
    levels = []  # from the longest: context numbers, byte counts
    context, symbol = keys >> 8, keys & 255
    for d in range(depth, -1, -1):
        own = context & ((1 << 8 * d) - 1)
        every, where = np.unique(own, return_inverse=True)
        table_ = np.bincount(where * 256 + symbol, counts, len(every) * 256).reshape(len(every), 256)
        levels.append((every, table_))
    if not len(levels[-1][0]):
        levels = [(np.zeros(1, np.int64), np.zeros((1, 256))) for _ in range(depth + 1)]
    below: np.ndarray | None = None  # sum of the children's weighted log-probabilities, per context and node
    nodes = []  # from the longest: context numbers, weight of the own estimate, own estimate of a one
    for d, (every, table_) in zip(range(depth, -1, -1), levels):
        zeros, ones = _bit_counts(table_)
        log_kt = _log_kt(zeros, ones)
        log_weighted = log_kt if below is None else np.logaddexp(log_kt, below) - math.log(2)
        share = np.ones_like(log_kt) if below is None else np.exp(log_kt - math.log(2) - log_weighted)
        nodes.append((every, share, (ones + 0.5) / (zeros + ones + 1)))
        if d:
            parents, where = np.unique(every & ((1 << 8 * (d - 1)) - 1), return_inverse=True)
            below = np.zeros((len(parents), 255))
            np.add.at(below, where, log_weighted)
    out = np.zeros(256 ** (depth + 1), np.float32)
    cells = out.reshape(-1, 256)
    # What shorter contexts have settled so far, what is left to longer ones, per context and node.
    settled, left, last = np.zeros((1, 255)), np.ones((1, 255)), np.zeros(1, np.int64)
    for d in range(depth + 1):
        every, share, estimate = nodes[depth - d]
        parent = np.searchsorted(last, every & ((1 << 8 * max(d - 1, 0)) - 1))
        settled = settled[parent] + left[parent] * share * estimate
        left, last = left[parent] * (1 - share), every
        # Longer contexts that never occurred get a fair coin for the rest, unless they are written next.
        for at in range(0, len(every), 4096):
            rows = _symbols(settled[at : at + 4096] + left[at : at + 4096] * 0.5)
            for suffix, row in zip(every[at : at + 4096].tolist(), rows):
                cells[suffix :: 1 << 8 * d] = row
    return out


def _symbols(ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes, from those of a one at the 255 decision nodes."""
    log_one, log_zero = np.log10(ones), np.log10(1 - ones)
    out = np.zeros((len(ones), 512))
    for node in range(1, 256):
        out[:, 2 * node] = out[:, node] + log_zero[:, node - 1]
        out[:, 2 * node + 1] = out[:, node] + log_one[:, node - 1]
    return out[:, 256:]


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in the order of the first column, in blocks that never cut a part with one number."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size >= TREE_ROWS:
            columns = [np.concatenate(x) for x in zip(*waiting)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield [c[:cut] for c in columns]
            waiting, size = [[c[cut:] for c in columns]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*waiting)]


def code_lengths(counts: DataFrame, depth: int) -> DataFrame:
    """(gram, code): log10 probability of every row of the counts (``gram``, ``n``)."""
    top = min(SPLIT, depth)
    part = F.shiftright("gram", 8).bitwiseAND((1 << 8 * top) - 1)
    rows = counts.select(part.alias("part"), "gram", F.col("n").cast("double").alias("n"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n in _whole_parts(batches):
            levels, sums, _ = subtrees(keys, n, top, depth)
            yield pa.RecordBatch.from_arrays([pa.array(levels[0][0]), *map(pa.array, sums)], ["place", "zeros", "ones", "weighted"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zeros, ones, below = (batch.column(k).to_numpy() for k in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, _weighted(zeros, ones, below))], ["place", "zeros", "ones", "weighted", "share", "estimate"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n, settled, left in _whole_parts(batches):
            state, own = np.flatnonzero(n < 0), np.flatnonzero(n >= 0)
            state = state[np.argsort(keys[state])]
            keys, n = keys[own], n[own]
            levels, _, where = subtrees(keys, n, top, depth)
            for _, ones, _ in _mixed(levels, top, settled[state], left[state]):
                pass  # at full depth nothing is left
            ones = ones[where].reshape(-1, 8)
            codes = np.where(_bits(keys) == 1, np.log10(ones), np.log10(1 - ones)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(codes)], ["gram", "code"])

    def above(d: int) -> Column:
        return F.col("place").bitwiseAND((1 << 8 * d) - 1 & -256).bitwiseOR(F.col("place").bitwiseAND(255))

    kind = "place long, zeros double, ones double, weighted double"
    lowest = stage(rows.repartition("part").sortWithinPartitions("part").mapInArrow(up, kind), "tree-parts")
    levels = []
    for d in range(top, 0, -1):
        lower = levels[-1] if levels else lowest
        sums = lower.groupBy(above(d).alias("place")).agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "weighted")))
        levels.append(stage(sums.mapInArrow(weigh, kind + ", share double, estimate double"), "tree-level"))
    state = None
    for d, level in enumerate(reversed(levels)):
        if state is None:
            level = level.withColumn("settled", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            level = level.withColumn("upper", above(d)).join(state, "upper")
        state = level.select(
            F.col("place").alias("upper"), (F.col("settled") + F.col("left") * F.col("share") * F.col("estimate")).alias("settled"),
            (F.col("left") * (1 - F.col("share"))).alias("left"),
        )
    if state is None:
        start = lowest.withColumn("settled", F.lit(0.0)).withColumn("left", F.lit(1.0))
    else:
        start = lowest.withColumn("upper", above(top)).join(stage(state, "tree-mixed"), "upper")
    start = start.select(F.shiftright("place", 8).alias("part"), F.col("place").alias("gram"), F.lit(-1.0).alias("n"), "settled", "left")
    both = rows.withColumn("settled", F.lit(0.0)).withColumn("left", F.lit(0.0)).unionByName(start)
    return both.repartition("part").sortWithinPartitions("part").mapInArrow(down, "gram long, code double")


def row_grams(docs: DataFrame, hot, depth: int) -> DataFrame:
    """(row, gram, n) of each text: the bytes in context that are not in the table of hot ones and their times.

    Every text has one row more, with a number below 0 that no byte in context has; its ``n``
    is the sum of the code lengths of those that are in the table.
    """
    schema = pa.schema([("row", pa.int64()), ("gram", pa.int64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes = hot.value
        for batch in batches:
            rows, found, times, size = [], [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, total = lowered(text), 0.0
                for at in range(0, len(raw) + 1, BLOCK):  # a long text in blocks
                    part = grams(raw[max(0, at - depth) : at + BLOCK], depth)
                    part = part[min(at, depth) :] if at else part
                    if at + BLOCK < len(raw) + 1:
                        part = part[:BLOCK]
                    # Sorted first: neighbours are then looked up side by side, and each one once.
                    rest, n = np.unique(part, return_counts=True)
                    if len(keys):
                        places = np.minimum(np.searchsorted(keys, rest), len(keys) - 1)
                        hit = keys[places] == rest
                        total += float((codes[places[hit]] * n[hit]).sum())
                        rest, n = rest[~hit], n[~hit]
                    rows.append(np.full(len(rest), row)), found.append(rest), times.append(n.astype(np.float64))
                    size += len(rest)
                rows.append([row]), found.append([-1 - (row & 0x7FFFFFFFFFFFFFF)]), times.append([total])
                if size >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, found, times)], schema=schema)
                    rows, found, times, size = [], [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (rows, found, times)], schema=schema)

    return docs.select("row", "_text").mapInArrow(run, "row long, gram long, n double")


# --- words ---------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Lower-case words; the empty one at the end stands for the end of the text."""
    return [*lowered(text).split(), b""]


def word_counts(docs: DataFrame) -> DataFrame:
    """Count of every word over texts; tasks sum up their own rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flushed():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
            )
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) >= GATHERED:
                    yield from flushed()
        if counts:
            yield from flushed()

    return docs.select("_text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def word_rows(docs: DataFrame, hot) -> DataFrame:
    """Two kinds of rows: one per text with its own figures, and (row, word, n) of its words that are not in the table of hot ones.

    The figures are in one pass with the words, since both need every word. The row of a
    text has a word that no text has, so that these rows spread in a join on the word.
    """
    figures = "n_tokens long, hot_known long, hot_base double, n_bytes long"
    schema = StructType(
        [*StructType.fromDDL("row long, word binary, n int").fields, docs.schema["key"], docs.schema["held_out"], *StructType.fromDDL(figures).fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log10, names = hot.value, math.log10, schema.names

        def rest(rows: list, words: list, times: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
            own = [pa.array(rows, pa.int64()), pa.array(words, pa.binary()), pa.array(times, pa.int32())]
            return pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(rows), kind) for kind in kinds)], names)

        for batch in batches:
            kinds = [batch.column(1).type, batch.column(2).type, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            rows, words, times, own, markers = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                raw = lowered(text)
                every = raw.split()
                counts, found, base = Counter(every), 0, 0.0
                counts[b""] = 1  # the end
                for word, n in counts.items():
                    c = known.get(word)
                    if c is None:
                        words.append(word), times.append(n), rows.append(row)
                    else:
                        found += n
                        base += n * log10(c + 0.5)
                own.append((len(every) + 1, found, base, len(raw) + 1))
                markers.append(row.to_bytes(8, "big", signed=True) + b" ")
                if len(rows) >= 100_000:
                    yield rest(rows, words, times, kinds)
                    rows, words, times = [], [], []
            yield rest(rows, words, times, kinds)
            made = [pa.array([x[k] for x in own], kind) for k, kind in enumerate(kinds[2:])]
            first = [batch.column(0), pa.array(markers, pa.binary()), pa.nulls(len(own), pa.int32())]
            yield pa.RecordBatch.from_arrays([*first, batch.column(1), batch.column(2), *made], names)

    return docs.select("row", "key", "held_out", "_text").mapInArrow(run, schema)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, held_out: int = HELD_OUT) -> DataFrame:
    """Key, held-out flag, token figures, base score, model score and bits per byte of every text.

    Model and counts come from the rows that are not held out. ``score`` is the log10
    probability of the lower-cased text and its end; ``bits_per_byte`` is its code length
    per byte, the end included. A null text counts as empty; a null key counts as the
    empty text for the split; repeated rows each count and stay; other columns are left
    out. Without training rows the model is a fair coin.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(
        F.col(f"`{key}`").alias("key"), content.alias("_text"), F.xxhash64(F.col(f"`{key}`"), content).alias("row"),
        (~is_training(F.col(f"`{key}`"), held_out)).alias("held_out"),
    )
    training = docs.filter(~F.col("held_out"))
    spark = df.sparkSession
    vocabulary = stage(word_counts(training), "word-counts")
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums.n, sums.v
    frequent = vocabulary.filter(F.col("c") * HOT >= n).collect()  # HOT rows at most
    hot = spark.sparkContext.broadcast({bytes(r.word): r.c for r in frequent})
    grams_ = stage(gram_counts(docs, depth), "gram-counts")
    codes = stage(code_lengths(grams_.select("gram", "n"), depth), "gram-codes")
    every = grams_.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = grams_.filter(F.col("times") * HOT_GRAMS >= every).join(codes, "gram").select("gram", "code").toArrow()  # HOT_GRAMS rows at most
    keys, values = (common.column(k).to_numpy() for k in range(2))
    order = np.argsort(keys)
    looked_up = spark.sparkContext.broadcast((keys[order], values[order]))

    joined = word_rows(docs, hot).join(vocabulary, "word", "left")
    c = F.coalesce("c", F.lit(0))
    # Repeated rows share one number, so their sums hold every one of them.
    times = joined.groupBy("row").agg(
        F.count("n_tokens").alias("times"),
        *(F.first(x, ignorenulls=True).alias(x) for x in ("key", "held_out", "n_tokens", "hot_known", "hot_base", "n_bytes")),
        F.sum(F.when(c > 0, F.col("n"))).alias("rare_known"),
        F.sum(F.col("n") * F.log10(c + 0.5)).alias("rare_base"),
    )
    coded = row_grams(docs, looked_up, depth).join(codes, "gram", "left").groupBy("row")
    coded = coded.agg(F.sum(F.when(F.col("gram") < 0, F.col("n")).otherwise(F.col("n") * F.coalesce("code", F.lit(0.0)))).alias("coded"))
    both = times.join(coded, "row").withColumn("score", F.col("coded") / F.col("times")).select(
        "*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")
    )
    rare_base = F.coalesce(F.col("rare_base") / F.col("times"), F.lit(0.0))
    return both.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce((F.col("rare_known") / F.col("times")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_base") + rare_base - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


@query("op4_context_tree")
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
