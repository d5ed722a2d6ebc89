"""Near duplicates by consistent weighted sampling over TF-IDF shingles.

1. Texts with equal normalised words are one node, found by a hash.
2. Document frequencies of shingles go into a count-min sketch of fixed size, over all
   documents; it is the only thing about the corpus that every task gets.
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per node; two
   nodes draw the same sample with a probability equal to their weighted Jaccard
   similarity. Samples are banded; nodes that share a band are candidates.
4. In a bucket every node is compared with one hub first, the node with the most company
   over all bands, which for copies of an original is the original. So a bucket of n
   nodes gives n - 1 pairs. Every pair is verified by its weighted Jaccard similarity.
5. Where a comparison with a hub fails, links between other members may remain. Buckets
   of more than ``SMALL`` nodes that have the same hub are one group. Its members that are
   not in its largest class yet, the rest, are compared with all members, block against
   block: a task gets two blocks of bounded size, sums what their texts have in common by
   matrix products and gives back just the links that join classes. First every block is
   compared with the rest in itself, which leaves few of them; then the rest with all
   blocks. Every pair of two classes of a bucket is compared.
6. In buckets of at most ``SMALL`` nodes all pairs between classes are then compared one by one.
7. Links are joined into classes by alternating star operations on tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.llm import shingles
from labelloom.llm.common import free_name, query, table
from labelloom.sources.staging import stage

#: Weighted Jaccard similarity from which two texts are near duplicates.
SIMILAR = 0.8
#: Bands and samples in a band: a pair at the threshold is missed once in 4,600.
BANDS, ROWS = 16, 4
#: Most nodes of a bucket in which all pairs between classes are compared: at most ``SMALL / 2`` for each member.
SMALL = 128
#: Shingles of texts that a task keeps at hand.
WEIGHED = 1 << 21
#: Most texts, and bytes of texts, of a block, about; a task compares two blocks.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: A shingle is counted in a matrix product if at least one in so many pairs of texts has it, else pair by pair.
DENSE = 100
#: Columns of a matrix, and pairs counted one by one, at a time.
COLUMNS, PAIRS = 256, 1 << 17
#: Cells in each of the two rows of the sketch of document frequencies, and how it is cut for summing.
SKETCH, SKETCH_PARTS = 1 << 19, 64
#: How much rarer shingles weigh: from 1 for one in every document to 1 + RARITY for one in a single document.
RARITY = 0.25


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, one blank apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def node_of(text: Column, words: Column) -> Column:
    """Hash of the normalised words, or of the text itself if it has none."""
    return F.when(words != "", F.xxhash64(words)).otherwise(F.xxhash64(F.lit("no words"), F.coalesce(text, F.lit(""))))


# --- weights -----------------------------------------------------------------------


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(SKETCH - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def sketch_of(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequencies of all shingles as a sketch, the number of documents and of entries.

    Every task fills a sketch of its own; the parts are summed by a shuffle. Its size,
    2 * SKETCH numbers, does not depend on the data.
    """
    width = 2 * SKETCH // SKETCH_PARTS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, waiting = np.zeros(2 * SKETCH, np.int64), 0, []

        def add() -> None:
            if waiting:
                both = np.concatenate(waiting)
                waiting.clear()
                own[:] += np.bincount(both, minlength=2 * SKETCH)

        size = 0
        for batch in batches:
            n += batch.num_rows
            for _, hashes, _, _ in shingles.groups(batch.column(0).to_pylist()):
                first, second = _cells(hashes)
                waiting += [first, second + SKETCH]
                size += len(first)
                if size > 1 << 20:
                    add()
                    size = 0
        add()
        if n:
            parts = own.astype(np.int32).reshape(SKETCH_PARTS, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * SKETCH_PARTS, pa.int64())],
                ["part", "cells", "n"],
            )

    def total(group: pa.Table) -> pa.Table:
        sums = np.zeros(width, np.int64)
        for cells in group.column("cells").to_pylist():
            sums += np.frombuffer(cells, np.int32)
        return pa.table({"part": group.column("part")[:1], "cells": pa.array([sums.tobytes()], pa.binary()), "n": pa.array([sum(group.column("n").to_pylist())], pa.int64())})

    filled = docs.select("words").mapInArrow(fill, "part int, cells binary, n long")
    parts = filled.groupBy("part").applyInArrow(total, "part int, cells binary, n long").collect()
    out, n = np.zeros(2 * SKETCH, np.int64), 0
    for row in parts:
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.cells, np.int64)
        n = row.n
    return out, n, int(out[:SKETCH].sum())


class Weights:
    """TF-IDF weights of shingles from the sketch."""

    def __init__(self, sketch: np.ndarray, documents: int, entries: int):
        # Every cell holds strangers too: their expected number is taken off.
        self.first, self.second = (
            np.maximum(part - entries / SKETCH, 1.0).astype(np.float32) for part in (sketch[:SKETCH], sketch[SKETCH:])
        )
        self.documents = max(documents, 2)

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        one, two = _cells(hashes)
        frequency = np.minimum(np.minimum(self.first[one], self.second[two]), self.documents)
        return times * (1 + RARITY * (1 - np.log(frequency) / math.log(self.documents)))


# --- samples -----------------------------------------------------------------------


class Sampler:
    """Improved consistent weighted sampling with tables of the random variables.

    For sample k and a shingle of weight w, with r and c from Gamma(2, 1) and b uniform,
    all read from the bits of a hash of shingle and k: t = floor(ln w / r + b) and
    ln a = ln c - r (t - b + 1). The sample is the shingle and t with the least a; the
    number a stands for both.
    """

    def __init__(self, n: int, seed: int = 1):
        self.seeds = shingles.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        random = np.random.default_rng(seed)
        self.r = random.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)

    def samples(self, hashes: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row of samples for each text with shingles."""
        log_w = np.log(weights).astype(np.float32)
        out = np.empty((len(self.seeds), len(offsets)), np.float32)
        low = np.uint64(0xFFFF)
        for k, seed in enumerate(self.seeds):
            z = (hashes ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
            z *= np.uint64(0x94D049BB133111EB)
            at = ((z >> np.uint64(48)) & low).astype(np.int32)
            r = self.r[at]
            b = ((z >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(log_w * self.inverse[at] + b)
            a = self.log_c[((z >> np.uint64(16)) & low).astype(np.int32)] - r * (t - b + np.float32(1))
            out[k] = np.minimum.reduceat(a, offsets)
        return out.T


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One number for the samples of each band."""
    bits = np.ascontiguousarray(samples).view(np.uint32).astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(ROWS):
        out = shingles.mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, weights) -> DataFrame:
    """Key, node and band keys of every document; texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sampler = weights.value, Sampler(BANDS * ROWS)
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fresh = {n: t for n, t in zip(nodes, texts) if n not in known}
            if len(known) + len(fresh) > 50_000:
                known, fresh = {}, dict(zip(nodes, texts))
            names = list(fresh)
            for first, hashes, times, offsets in shingles.groups(list(fresh.values())):
                full = np.flatnonzero(np.diff(offsets))
                for name in names[first : first + len(offsets) - 1]:
                    known[name] = np.zeros(0, np.int64)
                if len(full):
                    keys = band_keys(sampler.samples(hashes, own.of(hashes, times), offsets[:-1][full]))
                    for k, row in zip(full.tolist(), keys):
                        known[names[first + k]] = row
            rows = [known[n] for n in nodes]
            lists = pa.ListArray.from_arrays(
                np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate(rows) if rows else [], pa.int64())
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["key", "node", "bands"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "node", "words").mapInArrow(run, f"key {kind}, node long, bands array<long>")


# --- candidates --------------------------------------------------------------------


def bucket_members(buckets: DataFrame) -> DataFrame:
    """Members (``bucket``, ``node``) of buckets with more than one, the bucket's size and the company the node has over all buckets."""
    sized = buckets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).filter("n > 1")
    return sized.withColumn("company", F.sum("n").over(Window.partitionBy("node")))


def hub_pairs(members: DataFrame) -> DataFrame:
    """(node, hub) pairs of buckets: every member with the member that has the most company."""
    best = F.max(F.struct("company", "node")).over(Window.partitionBy("bucket"))
    return members.withColumn("hub", best["node"]).filter("node != hub").select("node", "hub").distinct()


def pairs_within(members: DataFrame, also: Column) -> DataFrame:
    """(node, hub) pairs of all members (``bucket``, ``node``, ``node_root``) of a bucket that are not in one class yet.

    The condition may name the members' further columns, those of the hub with ``hub_`` before them.
    """
    other = members.select(*(F.col(c).alias({"bucket": "_bucket", "node": "hub", "node_root": "hub_root"}.get(c, f"hub_{c}")) for c in members.columns))
    same = (F.col("bucket") == F.col("_bucket")) & (F.col("node") > F.col("hub")) & (F.col("node_root") != F.col("hub_root"))
    return members.join(other, same & also).select("node", "hub").distinct()


def rooted(frame: DataFrame, roots: DataFrame, name: str = "node") -> DataFrame:
    """A frame with the class so far of a column's nodes; ``roots`` has that of every linked node."""
    own = roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    return frame.join(own, name, "left").withColumn(f"{name}_root", F.coalesce(f"{name}_root", name))


def compare(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """Similarity of node and hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value
        known: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        size = 0

        def weighed(node: int, text: str) -> tuple[np.ndarray, np.ndarray, float]:
            nonlocal size
            if node not in known:
                if size > WEIGHED:
                    known.clear()
                    size = 0
                _, hashes, times, _ = next(shingles.groups([text]))
                w = own.of(hashes, times)
                known[node] = hashes, w, float(w.sum())
                size += len(hashes)
            return known[node]

        for batch in batches:
            nodes, hubs, node_words, hub_words = (batch.column(k).to_pylist() for k in range(4))
            similar = []
            for node, hub, text, hub_text in zip(nodes, hubs, node_words, hub_words):
                h, v, total_v = weighed(hub, hub_text)
                g, w, total_w = weighed(node, text)
                _, at, to = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                common = float(np.minimum(w[at], v[to]).sum())
                every = total_v + total_w - common
                similar.append(common / every if every else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.float64())], ["node", "hub", "similarity"])

    left = pairs.join(texts, "node").select("node", "hub", F.col("words").alias("node_words"))
    both = left.join(texts.select(F.col("node").alias("hub"), F.col("words").alias("hub_words")), "hub")
    return both.select("node", "hub", "node_words", "hub_words").mapInArrow(run, "node long, hub long, similarity double")


def once(pairs: DataFrame) -> DataFrame:
    """Every pair in one direction only."""
    ends = pairs.groupBy(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).agg(F.min(F.struct("node", "hub")).alias("p"))
    return ends.select("p.node", "p.hub")


def new_pairs(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs, in one direction, that have not been compared in either."""
    old = done.select("node", "hub").unionByName(done.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
    return stage(once(pairs).join(old, ["node", "hub"], "left_anti"), "dedup-pairs")


# --- groups of large buckets -------------------------------------------------------


def hub_members(pairs: DataFrame) -> DataFrame:
    """Members (``hub``, ``node``) of every hub: the nodes that have it as their hub, the hubs that it has, and itself."""
    hubs = pairs.select("hub").distinct()
    other = pairs.select(F.col("node").alias("hub"), F.col("hub").alias("node")).join(hubs, "hub", "left_semi")
    return pairs.select("hub", "node").unionByName(other).unionByName(hubs.withColumn("node", F.col("hub"))).distinct()


def open_hubs(members: DataFrame) -> DataFrame:
    """Hubs with members (``hub``, ``node``, ``size``, ``node_root``) of more than one class: the largest class, the blocks of all members and those of the rest."""
    classes = members.groupBy("hub", "node_root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    hubs = classes.groupBy("hub").agg(F.max(F.struct("n", "node_root", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size"))

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    return hubs.filter(F.col("n") > F.col("most.n")).select(
        "hub", F.col("most.node_root").alias("main"), blocks(F.col("n"), F.col("size")).alias("blocks"),
        blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("rest_blocks"),
    )


def _weighed(texts: list[str], own: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts, each as often as the text has it, under names of their own; number of the text and weight."""
    names, owners, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for first, hashes, times, offsets in shingles.groups(texts):
        again = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        name = np.repeat(hashes, times)
        names.append(np.where(again > 0, shingles.mix(name + again * np.uint64(0x9E3779B97F4A7C15)), name))
        owners.append(np.repeat(np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets)), times))
        weights.append(np.repeat(own.of(hashes, np.ones(len(hashes), np.int64)), times))
    return np.concatenate(names), np.concatenate(owners), np.concatenate(weights)


def similarities(left: list[str], right: list[str], own: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of every left text with every right one."""
    (name, a, w), (other, b, v) = _weighed(left, own), _weighed(right, own)
    shape = len(left), len(right)
    names, at = np.unique(np.concatenate([name, other]), return_inverse=True)
    at, to = at[: len(name)], at[len(name) :]
    n_at, n_to = np.bincount(at, minlength=len(names)), np.bincount(to, minlength=len(names))
    often = n_at * n_to * DENSE > shape[0] * shape[1]
    common = np.zeros(shape)
    columns = np.flatnonzero(often)
    for start in range(0, len(columns), COLUMNS):
        chosen = columns[start : start + COLUMNS]
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        x, y = np.zeros((shape[0], len(chosen))), np.zeros((shape[1], len(chosen)))
        in_x, in_y = place[at] >= 0, place[to] >= 0
        x[a[in_x], place[at[in_x]]] = w[in_x]
        y[b[in_y], place[to[in_y]]] = 1
        common += x @ y.T
    # Entries of the right by name; every left entry of a rarer name meets those of the same name.
    by_name = b[np.argsort(to, kind="stable")]
    begins = np.cumsum(n_to) - n_to
    rare = np.flatnonzero(~often[at] & (n_to[at] > 0))
    met = np.cumsum(n_to[at[rare]])
    flat = common.reshape(-1)
    start = 0
    while start < len(rare):
        end = max(start + 1, int(np.searchsorted(met, (met[start - 1] if start else 0) + PAIRS, "right")))
        e = rare[start:end]
        times = n_to[at[e]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(flat, np.repeat(a[e] * shape[1], times) + by_name[np.repeat(begins[at[e]], times) + within], np.repeat(w[e], times))
        start = end
    every = np.bincount(a, w, shape[0])[:, None] + np.bincount(b, v, shape[1])[None, :] - common
    return np.divide(common, every, out=np.zeros(shape), where=every > 0)


def joining(similar: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the (left, right) pairs that are similar, those that join classes; ``left`` and ``right`` have the classes so far."""
    left, right, out = left.copy(), right.copy(), []
    for k in np.flatnonzero(similar.any(axis=1)):
        found = np.flatnonzero(similar[k])
        found = found[right[found] != left[k]]
        if len(found):
            classes, first = np.unique(right[found], return_index=True)
            out += [(int(k), int(m)) for m in found[first]]
            own = left[k]
            left[np.isin(left, classes)] = own
            right[np.isin(right, classes)] = own
    return out


def further_pairs(members: DataFrame, hubs: DataFrame, texts: DataFrame, weights, similar: float, across: bool) -> DataFrame:
    """Similar (node, hub) pairs of members of one hub that join classes: of the rest with all members of its block, or ``across`` all blocks.

    ``members`` has ``hub``, ``node`` and ``node_root``, ``hubs`` is from ``open_hubs``.
    """

    def run(block: pa.Table) -> pa.Table:
        nodes, roots = block.column("node").to_numpy(), block.column("node_root").to_numpy()
        words = block.column("words").to_pylist()
        left, right = (np.flatnonzero(block.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            alike = similarities([words[k] for k in left], [words[k] for k in right], weights.value) >= similar
            found = joining(alike, roots[left], roots[right])
        return pa.table({"node": pa.array([nodes[left[k]] for k, _ in found], pa.int64()), "hub": pa.array([nodes[right[m]] for _, m in found], pa.int64())})

    rows = members.join(hubs, "hub").join(texts, "node")
    rest = F.col("node_root") != F.col("main")
    own, own_rest = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("blocks", "rest_blocks"))
    columns = ["hub", "node", "node_root", "words"]
    if across:
        every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "rest_blocks")]
        lefts = rows.filter(rest).select(*columns, own_rest.alias("i"), every[0].alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
        rights = rows.select(*columns, every[1].alias("i"), own.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
        blocks = lefts.unionByName(rights)
    else:
        blocks = rows.select(*columns, own.alias("i"), own.alias("j"), rest.alias("left"), F.lit(True).alias("right"))
    return blocks.groupBy("hub", "i", "j").applyInArrow(run, "node long, hub long")


# --- classes -----------------------------------------------------------------------


def components(links: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(node, root) of all linked nodes, root being the least node of the component.

    ``linked`` has those of links that came before.
    Alternates the large-star and the small-star operation until the edges stay the
    same; each half step is a grouping and a join, and is written out.
    """
    if linked is not None:
        links = links.select("a", "b").unionByName(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = stage(edges, "dedup-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = stage(large, "dedup-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u != v").distinct(), "dedup-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: key, class and number of verified links of its text, as far as the class needed them.

    ``class_id`` is the least key of the class; texts with equal normalised words are
    always in one class, and so are all null and empty texts; other texts without words
    are only equal to themselves. A null key is greater than all others. Repeated rows
    stay; other columns are left out. An empty table gives no rows.
    """
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("_text"))
    docs = source.withColumn("words", normalised(F.col("_text"))).withColumn("node", node_of(F.col("_text"), F.col("words")))
    spark = df.sparkSession
    weights = spark.sparkContext.broadcast(Weights(*sketch_of(docs)))  # of fixed size
    signed = stage(signatures(docs, weights), "dedup-signatures")
    nodes = signed.groupBy("node").agg(F.min("key").alias("key"))
    bands = signed.select("node", F.explode("bands").alias("bucket")).distinct()
    members = stage(bucket_members(bands), "dedup-members")
    small = members.filter(F.col("n") <= SMALL)
    wide = stage(hub_pairs(members.filter(F.col("n") > SMALL)), "dedup-wide")
    pairs = stage(once(wide.unionByName(hub_pairs(small))), "dedup-pairs")
    # The texts of candidates, one row per node: the document with the least key stands for its copies.
    wanted = pairs.select("node").union(pairs.select("hub")).distinct().join(nodes, "node")
    chosen = docs.alias("d").join(
        wanted.alias("w"), (F.col("d.node") == F.col("w.node")) & F.col("d.key").eqNullSafe(F.col("w.key")), "left_semi"
    )
    texts = stage(chosen.select("node", "words").dropDuplicates(["node"]), "dedup-texts")

    def linking(compared: DataFrame) -> DataFrame:
        return compared.filter(F.col("similarity") >= similar).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))

    links = linking(stage(compare(pairs, texts, weights), "dedup-compared"))
    linked = components(links)
    if not wide.isEmpty():
        sizes = texts.select("node", F.octet_length("words").alias("size"))
        groups = stage(hub_members(wide).join(sizes, "node"), "dedup-groups")
        for across in (False, True):
            own = stage(rooted(groups, linked), "dedup-members")
            hubs = stage(open_hubs(own).filter(F.col("blocks") > F.lit(1 if across else 0)), "dedup-hubs")
            if not hubs.isEmpty():
                joined = stage(further_pairs(own.drop("size"), hubs, texts, weights, similar, across), "dedup-joined")
                found = joined.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"))
                links, linked = links.unionByName(found), components(found, linked)
    # A node has at most one bucket for each band; a pair comes up in the first one of both.
    within = rooted(small, linked).withColumn("buckets", F.collect_list("bucket").over(Window.partitionBy("node")))
    first_of_both = F.array_min(F.array_intersect("buckets", "hub_buckets")) == F.col("bucket")
    rest = new_pairs(pairs_within(within.select("bucket", "node", "node_root", "buckets"), first_of_both), pairs)
    found = linking(stage(compare(rest, texts, weights), "dedup-compared"))
    links, linked = links.unionByName(found), components(found, linked)
    links = links.distinct()
    degrees = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("key").alias("class_id"))
    classes = known.join(least, "root").join(degrees, "node", "left").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("key", "node").join(classes, "node").select(F.col("key").alias(key), "class_id", "n_links")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns: the one with the least key.

    Repeated rows with this key leave one of them. Classes in which every key is null
    keep one row for each different text.
    """
    classes = near_duplicates(df, key, text, similar)
    kept_key, node = free_name(df, "_kept"), free_name(df, "_node")
    first = F.col(key).eqNullSafe(F.col("class_id"))
    kept = classes.filter(first).groupBy(F.col(key).alias(kept_key)).agg(F.count(F.lit(1)).alias("_rows"))
    kept = stage(kept, "dedup-kept")
    rows = df.join(kept.select(kept_key), F.col(f"`{key}`").eqNullSafe(F.col(kept_key)), "left_semi")
    if kept.filter("_rows > 1").isEmpty():
        return rows
    words = normalised(F.col(f"`{text}`"))
    return rows.withColumn(node, node_of(F.col(f"`{text}`"), words)).dropDuplicates([key, node]).drop(node)


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
