"""Alignment of two tokenizers over distinct texts.

Texts are shuffled by their whole content and counted; each distinct one is cut by both
vocabularies once. Tokens of the two that share bytes are linked; where both end, a
group ends. A pair of ids counts once for every document that holds it linked, so the
pairs of a text weigh as much as the text has copies. The measures of a distinct text
go back to its documents by the digest of the text.

Pairs that most documents hold are looked up in a broadcast table of bounded size, all
others are joined; what a document sums up does not depend on which way a pair takes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import bpe, merges
from labelloom.llm.common import map_texts, query, table
from labelloom.sources.staging import stage

#: Most pairs that are looked up instead of joined: 17 bytes each.
MOST_LOOKED_UP = 1 << 18
#: From this length on a run with or without white space goes to the linear encoder.
LONG_RUN = 50_000
_LONG = re.compile(rf"[{bpe._WS}]{{{LONG_RUN}}}|[^{bpe._WS}]{{{LONG_RUN}}}")

MEASURES = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Groups and links of texts under a byte-level and a piece vocabulary.

    The ids come from the compiled encoders, the first one from the ranks of the
    vocabulary's merges; ends of tokens are running sums of their lengths in bytes.
    """

    def __init__(self, a: dict, b: merges.Pieces):
        import sentencepiece
        import tiktoken

        self.linear: bpe.Codec | None = None
        self.vocabulary = a
        order = {bytes([k]): k for k in range(256)}
        for left, right in a["merges"]:
            order.setdefault(left + right, len(order))
        self.encoder = tiktoken.Encoding("byte-level", pat_str=bpe.SPLIT, mergeable_ranks=order, special_tokens={})
        self.id_a = np.array([a["tokens"][token] for token in order], np.int64)
        self.pieces = merges.Codec(b)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=b.file)
        self.length_a = np.zeros(int(self.id_a.max()) + 1, np.int64)
        self.length_a[self.id_a] = [len(token) for token in order]
        # Every id with each of the signs that may follow it.
        size = max(len(self.length_a), len(b.pieces))
        self.signed = [f"{i}{sign}".encode() for i in range(size) for sign in ",|;"]

    def ids_a(self, text: str) -> np.ndarray:
        if len(text) < LONG_RUN or not _LONG.search(text):
            return self.id_a[self.encoder.encode_ordinary(text)]
        # Special tokens are plain text here.
        self.linear = self.linear or bpe.Codec(self.vocabulary | {"special": {}})
        return self.linear.ids(text).astype(np.int64)

    def text(self, text: str) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray, np.ndarray] | None:
        """Both ids, the number of groups, the links, and the ids in the order of the groups; None where there are no tokens."""
        if not text:
            return None
        b = np.array(self.library.encode(text), np.int64)
        whole, a = (" " + text).encode(), self.ids_a(" " + text)
        lengths = self.pieces.length[b]
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(lengths)
        if not len(a) or not len(b) or ends_a[-1] != len(whole) or ends_b[-1] != len(whole) or self.surface(b) != whole:
            return None
        # One mark per byte: 1 where a token of A ends, 2 where one of B does, 3 for both. Between two
        # neighbouring marks lies one token of each: a link.
        marks = np.zeros(len(whole) + 1, np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        ends = marks[np.flatnonzero(marks)]
        of_a, of_b, both = (ends & 1).astype(bool), ends > 1, ends == 3
        at_a, at_b, group = (np.cumsum(x) - x for x in (of_a, of_b, both))
        return a, b, int(both.sum()), a[at_a] << 32 | b[at_b], group[of_a], group[of_b]

    def surface(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces stand for."""
        lengths = self.pieces.length[ids]
        ends = np.cumsum(lengths)
        return self.pieces.blob[np.arange(int(ends[-1])) + np.repeat(self.pieces.start[ids] - ends + lengths, lengths)].tobytes()

    def groups(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """Ids of A and B of every group as text."""
        # The place of a token: the tokens of its kind and of the other kind in front of it.
        n = int(group_a[-1]) + 1
        of_a, of_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        place_a = np.arange(len(a)) + (np.cumsum(of_b) - of_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(of_a)[group_b]
        out = np.empty(len(a) + len(b), np.int64)
        out[place_a] = 3 * a + np.append(group_a[1:] != group_a[:-1], True)
        out[place_b] = 3 * b + 2 * np.append(group_b[1:] != group_b[:-1], True)
        return b"".join(map(self.signed.__getitem__, out.tolist()))[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(key: tuple[str, str], a: dict, b: merges.Pieces) -> Aligner:
    return _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(a, b))


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256))


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Every distinct text with its digest and its number of rows; a null text counts as empty."""
    texts = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(_digest("text").alias("digest"), "copies", "text")


def align(texts: DataFrame, path_a: str, path_b: str, keys: tuple[str, ...] = ("digest", "copies"), with_groups: bool = False) -> DataFrame:
    """Key columns, token and group counts, the digest of the groups, and distinct linked id pairs with their times, for every text.

    A pair is one number: the id of A times 2^32 plus the id of B. Texts that are null
    or empty or whose pieces do not give back their bytes have no tokens: zeros, an empty
    digest, no pairs. ``with_groups`` adds the groups themselves. Rows may repeat, keys
    may be null, very long texts are one row like any other.
    """
    context = texts.sparkSession.sparkContext
    a, b = context.broadcast(bpe.load(path_a)), context.broadcast(merges.read_pieces(path_b))

    def make():
        own = _aligner((path_a, path_b), a.value, b.value)

        def measure(value: str) -> tuple:
            found = own.text(value)
            if found is None:
                return 0, 0, 0, 0, "", [], [], ""
            a, b, n_groups, links, group_a, group_b = found
            pairs, times = np.unique(links, return_counts=True)
            groups = own.groups(a, b, group_a, group_b)
            digest = hashlib.sha256(groups).hexdigest()
            return len(a), len(b), n_groups, len(links), digest, pairs, times.astype(np.int32), groups.decode() if with_groups else ""

        return measure

    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, groups string"
    out = map_texts(texts, {k: k for k in keys}, "text", make, fields)
    return out if with_groups else out.drop("groups")


def pair_counts(aligned: DataFrame, copies: str = "copies") -> DataFrame:
    """How many documents hold each pair of ids linked, and whether no pair of its A id is held by more."""
    counts = aligned.select(copies, F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum(copies).alias("documents"))
    counts = stage(counts.withColumn("id_a", F.shiftright("pair", 32)), "pair-counts")
    most = stage(counts.groupBy("id_a").agg(F.max("documents").alias("most")), "pair-counts-most")
    return counts.join(most, "id_a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def looked_up(counts: DataFrame, most: int) -> DataFrame:
    """Pairs above the least count that leaves at most ``most`` of them; found from a histogram of their logarithms."""
    counts = counts.withColumn("bucket", F.floor(F.log2("documents") * 32).cast("int"))
    cut, total = None, 0
    for row in sorted(counts.groupBy("bucket").count().collect(), key=lambda r: -r["bucket"]):
        total += row["count"]
        if total > most:
            break
        cut = row["bucket"]
    return counts.filter(F.lit(False) if cut is None else F.col("bucket") >= cut).drop("bucket")


def measures(aligned: DataFrame, counts: DataFrame, most: int = MOST_LOOKED_UP) -> DataFrame:
    """For every digest its measures, the links whose pair is a best one, and the sum of the pair counts over all links."""
    session = aligned.sparkSession
    known = looked_up(counts, most).select("pair", "documents", "best").toPandas().sort_values("pair")
    shared = session.sparkContext.broadcast(
        (known["pair"].to_numpy(np.int64), known["documents"].to_numpy(np.int64), known["best"].to_numpy(bool))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, documents, best = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("pairs"))
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            own = lists.flatten().to_numpy().astype(np.int64)
            times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            hit = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            total, n_best = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, text[hit], times[hit] * documents[at[hit]])
            np.add.at(n_best, text[hit], times[hit] * best[at[hit]])
            # One row for the text with what was looked up, and one for each pair to be joined.
            # The text's own row gets a negative number, which is no pair and differs from text to text.
            rest = np.flatnonzero(~hit)
            row = np.concatenate([np.arange(batch.num_rows), text[rest]])
            first = np.arange(len(row)) < batch.num_rows
            spread = [-1 - int.from_bytes(d[:7], "big") for d in batch.column(0).to_pylist()]
            out = [
                batch.column(0).take(pa.array(row)),
                pa.array(np.concatenate([np.array(spread, np.int64), own[rest]])),
                pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), times[rest]])),
                pa.array(np.concatenate([total, np.zeros(len(rest), np.int64)])),
                pa.array(np.concatenate([n_best, np.zeros(len(rest), np.int64)])),
            ]
            for name in (*MEASURES, "groups_sha256"):
                values = batch.column(batch.schema.get_field_index(name)).take(pa.array(row))
                out.append(pa.compute.if_else(pa.array(first), values, pa.scalar(None, values.type)))
            yield pa.RecordBatch.from_arrays(out, ["digest", "pair", "times", "looked", "looked_best", *MEASURES, "groups_sha256"])

    counted = ", ".join(f"{m} long" for m in MEASURES)
    fields = f"digest binary, pair long, times long, looked long, looked_best long, {counted}, groups_sha256 string"
    rows = aligned.select("digest", "pairs", "times", *MEASURES, "groups_sha256").mapInArrow(run, fields)
    joined = rows.join(counts, "pair", "left")
    return joined.groupBy("digest").agg(
        *[F.max(m).alias(m) for m in (*MEASURES, "groups_sha256")],
        F.sum(F.col("looked_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("looked") + F.col("times") * F.coalesce("documents", F.lit(0))).alias("count_sum"),
    )


def compare(
    df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", most_looked_up: int = MOST_LOOKED_UP
) -> DataFrame:
    """Measures of the alignment of two vocabularies for every document.

    Space and text under the byte-level vocabulary A, the text under the piece
    vocabulary B. One row per row of ``df``; repeated rows and null keys stay, a null text
    counts as empty, other columns are left out, an empty table gives an empty one.
    Ties for the highest count of an A id all count as best.
    """
    aligned = stage(align(distinct_texts(df, text), path_a, path_b), "aligned-texts")
    counts = stage(pair_counts(aligned), "pair-counts-best")
    # Staged, so that the join with the documents shuffles it anew and can split a text with very many copies.
    each = stage(measures(aligned, counts, most_looked_up), "aligned-measures")
    keyed = df.select(F.col(f"`{key}`").alias("_key"), _digest(text).alias("digest"))
    return keyed.join(each, "digest", "left").select(
        F.col("_key").alias(key), *MEASURES, "n_best", "count_sum", "groups_sha256"
    )


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return compare(documents, bpe.vocabulary_path(), bpe.vocabulary_path("piece_bpe_32k.model"))
