"""Quality scores from preference pairs.

A Bradley-Terry model gives each document a worth; in a pair of a good and a bad
document the probability that the good one is preferred is the logistic function of the
difference of the worths. The worth is linear in features of the text, so the model is
fitted by logistic loss on feature differences. Documents are kept if their worth passes
a quantile of the worths of the labelled documents: the share of bad ones among them.

Every labelled training row counts, however many there are. A few are fitted by the driver;
beyond that tasks sum up gradient and curvature over pairs within groups of rows, and the
quantile is selected from the worths of all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import BLANK, is_training, map_texts, query, table
from labelloom.operators.ranking import kth_per_group
from labelloom.sources.staging import stage

#: Score from which a document is kept.
CUT = 0.3
#: Rows with ``crc32 % 5`` equal to this are held out.
HELD_OUT = 0
#: Labelled rows that reach the driver, at most, and buckets of the hash that chooses them if there are more.
MOST_LABELLED, BUCKETS = 20_000, 4_096
#: Partners drawn for every labelled row.
PARTNERS = 8
#: Labelled rows in a group of those that tasks fit, and rows of the rarer class that a group has at least, on average.
GROUP, GROUP_RARE = 1_000, 64
#: Decay of the weights and seed of the partners.
DECAY, SEED = 1e-3, 11

NAMES = (
    "words", "few_words", "very_few_words", "word_length", "long_words", "symbols", "symbol_words", "bars", "exclamations",
    "capitals", "capital_words", "digits", "other_signs", "distinct_words", "neighbours_equal", "repeated_windows",
    "repeated_lines", "line_words", "sentence_ends", "commas",
)
_SENTENCE_END = re.compile(r"[.!?](?=[\s]|$)")
_LETTER_CLASSES = bytes(
    1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57 else 4 if b in BLANK.encode() else 5 for b in range(256)
)


def _share(part: float, whole: int, more: int = 10) -> float:
    """Root of a share; ``more`` keeps a single odd sign from deciding about a very short text."""
    return math.sqrt(min(part / (whole + more), 1.0))


def features(text: str) -> tuple[list[float]]:
    """Features of a text, all from 0 to about 1; empty texts have a defined value for each."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    kinds = np.bincount(np.frombuffer(raw.translate(_LETTER_CLASSES), np.uint8), minlength=6)
    signs = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"~", b"^")))
    distinct = len(set(words))
    windows = list(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    letters = max(int(kinds[1] + kinds[2]), 1)
    out = [
        math.log1p(n) / 10,
        1.0 if n < 50 else 0.0,
        1.0 if n < 10 else 0.0,
        min(int(kinds[1] + kinds[2]) / max(n, 1), 20.0) / 20,
        _share(sum(len(w) > 24 for w in words), n),
        _share(signs, size, 50),
        _share(sum(not w[-1:].isalnum() and w[-1] in b"#*$%&<>~^" for w in words), n),
        _share(raw.count(b"|"), n),
        _share(raw.count(b"!"), n),
        _share(int(kinds[1]), letters, 50),
        _share(sum(w.isupper() and len(w) > 1 for w in words), n),
        _share(int(kinds[3]), size, 50),
        _share(int(kinds[5]), size, 50),
        (distinct + 10) / (n + 10),
        _share(sum(map(bytes.__eq__, words, words[1:])), n),
        _share(len(windows) - len(set(windows)), len(windows)),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1)) / 10,
        _share(len(_SENTENCE_END.findall(text)), n),
        _share(raw.count(b","), n),
    ]
    return (out,)


@dataclass(frozen=True)
class Ranking:
    """Weights of the worth, the worth at the cut, and the scale of the features."""

    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float

    def worths(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre) / self.scale) @ np.array(self.weights)

    def column(self) -> Column:
        """Worth of the features in column ``x``."""
        parts = [(F.col("x")[i] - c) / s * w for i, (w, c, s) in enumerate(zip(self.weights, self.centre, self.scale))]
        return sum(parts[1:], parts[0])


#: Log-likelihood, gradient and curvature, each a sum over pairs, and the number of pairs.
Sums = tuple[float, np.ndarray, np.ndarray, int]


def _pair_sums(difference: np.ndarray, weights: np.ndarray) -> Sums:
    worth = difference @ weights
    p = 1 / (1 + np.exp(-np.clip(worth, -30, 30)))
    return -float(np.logaddexp(0, -worth).sum()), difference.T @ (1 - p), (difference * (p * (1 - p))[:, None]).T @ difference, len(p)


def _newton(weights: np.ndarray, sums: Callable[[np.ndarray], Sums], decay: float) -> np.ndarray:
    """Weights at which the likelihood less the decay is greatest, by Newton steps that are halved where they go too far."""
    best, found = -math.inf, weights
    step = np.zeros_like(weights)
    for _ in range(60):
        likelihood, gradient, curvature, pairs = sums(found)
        value = likelihood / pairs - decay * (found @ found) / 2
        if value >= best - 1e-12:
            weights, best = found, value
            step = np.linalg.solve(curvature / pairs + decay * np.eye(len(weights)), gradient / pairs - decay * weights)
        else:
            step = step / 2
        found = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return found


def _differences(z: np.ndarray, y: np.ndarray, own: np.ndarray, partners: int, random: np.random.Generator) -> np.ndarray:
    """Good less bad row of pairs: every own row with ``partners`` rows of the other class."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    own_good, own_bad = good[own[good]], bad[own[bad]]
    if not len(good) or not len(bad):
        return z[:0]
    left = np.concatenate([np.repeat(own_good, partners), random.choice(good, partners * len(own_bad))])
    right = np.concatenate([random.choice(bad, partners * len(own_good)), np.repeat(own_bad, partners)])
    return z[left] - z[right]


def fit(x: np.ndarray, y: np.ndarray, partners: int = PARTNERS, decay: float = DECAY, seed: int = SEED) -> Ranking | None:
    """Bradley-Terry weights by Newton steps on pairs of a good and a bad row; None if one of the classes is empty.

    Every row gets ``partners`` rows of the other class, drawn by a seed, so the number
    of pairs follows the number of labelled rows.
    """
    bad = int((y == 0).sum())
    if not bad or not (y == 1).any():
        return None
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = (x - centre) / scale
    difference = _differences(z, y, np.ones(len(y), bool), partners, np.random.default_rng(seed))
    weights = _newton(np.zeros(x.shape[1]), lambda w: _pair_sums(difference, w), decay)
    worths = np.sort(z @ weights)
    # The cut lies between two labelled rows, at the quantile that is the share of bad ones.
    threshold = (worths[bad - 1] + worths[bad]) / 2
    return Ranking(tuple(weights), tuple(centre), tuple(scale), float(threshold))


def _grouped(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Staged (group, rows): every row in one group by its hash, and rows of a rare class in more groups as partners only."""
    rare = min(counts, key=lambda k: counts[k])
    groups = -(-sum(counts.values()) // GROUP)
    copies = min(groups, -(-GROUP_RARE * groups // counts[rare]))
    copy = F.explode(F.sequence(F.lit(0), F.when(F.col("_label") == rare, copies - 1).otherwise(0)))
    spread = rows.select("_order", "_label", "x", copy.alias("_copy")).withColumn("_own", F.col("_copy") == 0)
    group = F.pmod(F.pmod("_order", F.lit(groups)) + F.floor(F.col("_copy") * groups / copies), F.lit(groups))
    members = F.sort_array(F.collect_list(F.struct("_order", "_own", "_label", "x")))
    return stage(spread.groupBy(group.alias("_group")).agg(members.alias("rows")).sortWithinPartitions("_group"), "quality-groups")


def fit_table(
    rows: DataFrame, start: Ranking | None = None, partners: int = PARTNERS, decay: float = DECAY, seed: int = SEED
) -> Ranking | None:
    """``fit`` on all rows (``_order``, ``x``, ``_label``) of a staged table of any size.

    Partners are drawn within groups of about ``GROUP`` rows. Only sums reach the driver,
    one row of them per task and step. ``start`` has the weights of the first step.
    """
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    moments = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(NAMES))]
    centre, scale = np.array(rows.agg(*moments).first(), float).reshape(2, -1)
    scale, grouped, d = np.maximum(scale, 1e-6), _grouped(rows, counts), len(NAMES)

    def sums(weights: np.ndarray) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + d + d * d + 1)
            for batch in batches:
                for group, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own, label, x = (members.values.field(k) for k in (1, 2, 3))
                    z = (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - centre) / scale
                    own, label = own.to_numpy(zero_copy_only=False), label.to_numpy(zero_copy_only=False)
                    random = np.random.default_rng([seed, group])
                    value, gradient, curvature, pairs = _pair_sums(_differences(z, label, own, partners, random), weights)
                    total += np.concatenate([[value], gradient, curvature.ravel(), [pairs]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        parts = [r["sums"] for r in grouped.mapInArrow(run, "sums array<double>").collect()]
        whole = np.array([math.fsum(column) for column in zip(*parts)])
        return float(whole[0]), whole[1 : 1 + d], whole[1 + d : -1].reshape(d, d), int(whole[-1])

    first = np.zeros(d) if start is None else np.array(start.weights) / start.scale * scale
    model = Ranking(tuple(_newton(first, sums, decay).tolist()), tuple(centre.tolist()), tuple(scale.tolist()), 0.0)
    worths = stage(rows.select(F.lit(0).alias("_all"), model.column().alias("worth")), "quality-worths")
    # The same cut as in ``fit``, between the worths of two rows next to each other.
    low = kth_per_group(worths, ["_all"], ["worth"], counts[0]).first()["_cut"]["worth"]
    upto, above = worths.agg(
        F.count(F.when(F.col("worth") <= low, 1)), F.min(F.when(F.col("worth") > low, F.col("worth")))
    ).first()
    return replace(model, threshold=(low + (low if upto > counts[0] else above)) / 2)


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and features of every whole text."""
    return map_texts(df, {key: key}, text, lambda: features, "x array<double>")


def learned(rows: DataFrame, labels: DataFrame, key: str, label: str, most: int, held_out: int) -> Ranking | None:
    """Fit on all labelled training rows; the features of ``most`` of them at most reach the driver.

    If there are more, the driver's rows only give the first weights of ``fit_table``. They are
    chosen by hash: the first of ``BUCKETS`` buckets that together hold no more than ``most``
    rows, found from the buckets' counts. Rows that repeat key and text count once.
    """
    known = labels.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label")).filter(F.col("_label").isin(0, 1))
    # Repeated labels of a key that contradict each other count as no label.
    known = known.groupBy("_key").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter("_label = _other")
    order = F.xxhash64(key, "x")
    joined = rows.filter(is_training(key, held_out)).join(known, rows[key] == F.col("_key"))
    usable = joined.select(order.alias("_order"), F.pmod(order, F.lit(BUCKETS)).alias("_bucket"), "x", "_label").dropDuplicates(["_order"])
    usable = stage(usable, "quality-labelled")
    cut, total = 0, 0
    for row in sorted(usable.groupBy("_bucket").count().collect()):
        total += row["count"]
        if total <= most:
            cut = row["_bucket"] + 1
    chosen = usable.filter(F.col("_bucket") < cut).select("_order", "x", "_label").toPandas().sort_values("_order")
    model = fit(np.array(chosen["x"].tolist()), chosen["_label"].to_numpy()) if len(chosen) else None
    return fit_table(usable, model) if total > most else model


def rank(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_labelled: int = MOST_LABELLED,
    held_out: int = HELD_OUT,
    cut: float = CUT,
) -> DataFrame:
    """Key, held-out flag, worth, score and verdict of every document.

    The score is the logistic function of the distance from the threshold, moved so that
    the threshold scores ``cut``. Learning reads ``label`` of training rows only; a null
    label, or labels of one key that contradict each other, count as none. Without good
    and bad rows every worth is 0 and every score 0.5. A null text counts as empty;
    repeated rows and null keys stay; other columns are left out.
    """
    rows = stage(measured(df, key, text), "quality-features")
    model = learned(rows, labels, key, label, most_labelled, held_out)
    if model is None:
        worth, threshold = F.lit(0.0), math.log(cut / (1 - cut))
    else:
        worth, threshold = model.column(), model.threshold
    logit = F.col("worth") - threshold + math.log(cut / (1 - cut))
    scored = rows.withColumn("worth", worth).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), logit))))
    return scored.select(
        key,
        (~is_training(key, held_out)).alias("held_out"),
        "worth",
        "score",
        F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    most_labelled: int = MOST_LABELLED,
    held_out: int = HELD_OUT,
    cut: float = CUT,
) -> DataFrame:
    """The documents that ``rank`` would accept, with all their columns and in one more pass over the texts.

    Null labels, contradicting ones, null texts and repeated rows count as in ``rank``; without good and
    bad rows all documents stay. Columns may have any names.
    """
    model = learned(stage(measured(df, key, text), "quality-features"), labels, key, label, most_labelled, held_out)
    if model is None:
        return df  # every score is 0.5

    def make():
        def worth(value: str) -> tuple:
            return (float(model.worths(np.array(features(value)[0]))),)

        return worth

    keys = {f"_k{i}": c for i, c in enumerate(df.columns)}
    scored = map_texts(df, keys, text, make, "_worth double").filter(F.col("_worth") >= model.threshold)
    return scored.select(*(F.col(k).alias(c) for k, c in keys.items()))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return ranked.select("doc_id", "held_out", "score", "predicted", "worth")
