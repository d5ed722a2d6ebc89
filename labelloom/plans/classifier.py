"""Distributed text classifiers: word counts, and logistic regression on hashed terms.

``train_counts`` and ``score_counts`` are a multinomial Bayes classifier made of
aggregations and joins, with integer weights, so that a result can be computed
anywhere. ``train`` and ``score`` fit a logistic regression. ``train_epochs`` fits one in
small steps with a warm-up, looks at a development part after every epoch and keeps the
best epoch. All are simpler models than a fine-tuned transformer; no equal accuracy is
claimed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import truncate_tokens
from labelloom.operators.metrics import report
from labelloom.sources.staging import stage


def with_tokens(df: DataFrame, text: str = "text_clean", limit: int | None = None) -> DataFrame:
    """Add the words of whole texts, or of their first ``limit`` words."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w != "")
    return df.withColumn("tokens", words if limit is None else truncate_tokens(words, limit))


def train(
    df: DataFrame,
    label: str = "label",
    features: int = 1 << 14,
    iterations: int = 20,
    limit: int | None = None,
) -> PipelineModel:
    """Fit on (text_clean, label). Memory of the model: features x classes.

    Rows without a label are left out. The words are staged once; the passes of
    the fit read that table.
    """
    labelled = df.filter(F.col(label).isNotNull())
    named = with_tokens(labelled, limit=limit).select(F.col(label).cast("string").alias("_label"), "tokens")
    named = stage(named, "training")
    indexer = StringIndexer(inputCol="_label", outputCol="_index").fit(named)
    stages = [
        indexer,
        HashingTF(inputCol="tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(
            featuresCol="_features", labelCol="_index", predictionCol="_prediction",
            maxIter=iterations, regParam=1e-3, elasticNetParam=0.0,
        ),
        IndexToString(inputCol="_prediction", outputCol="prediction", labels=indexer.labels),
    ]
    return Pipeline(stages=stages).fit(named)


def score(model: PipelineModel, df: DataFrame, limit: int | None = None) -> DataFrame:
    """Add ``prediction`` (the best class) and its ``score``."""
    served = PipelineModel(stages=model.stages[1:])
    scored = served.transform(with_tokens(df, limit=limit))
    best = F.array_max(vector_to_array("probability"))
    return scored.select(*df.columns, "prediction", best.alias("score"))


def evaluate(scored: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and weighted F1."""
    return report(scored.withColumn("_truth", F.col(label).cast("string")), "_truth", "prediction")


#: Parts of a natural logarithm in which weights are counted.
LOG_PARTS = 1_000


def _weight(part: Column, whole: Column) -> Column:
    return F.round(F.log(part / whole) * LOG_PARTS).cast("bigint")


def train_counts(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(label, token, weight) and (label, prior, unseen) tables of whole texts, add-one smoothing.

    A token's weight is what it adds to the class beyond an unseen token. Rows without
    a label are left out. Counts are pre-aggregated before the shuffle.
    """
    labelled = df.filter(F.col(label).isNotNull())
    words = with_tokens(labelled).select(F.col(label).alias("label"), F.explode("tokens").alias("token"))
    counts = stage(words.groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")), "class-tokens")
    distinct = counts.select("token").distinct().count()
    rows = labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    sums = counts.groupBy("label").agg(F.sum("n").alias("total"))
    every = labelled.count()
    classes = rows.join(sums, "label", "left").select(
        "label",
        _weight(F.col("rows").cast("double"), F.lit(float(every))).alias("prior"),
        _weight(F.lit(1.0), F.coalesce("total", F.lit(0)) + float(distinct)).alias("unseen"),
    )
    classes = stage(classes, "classes")
    tokens = counts.select("label", "token", F.round(F.log(F.col("n") + F.lit(1.0)) * LOG_PARTS).cast("bigint").alias("weight"))
    return stage(tokens, "token-weights"), classes


def score_counts(model: tuple[DataFrame, DataFrame], df: DataFrame, row_id: str) -> DataFrame:
    """(row id, prediction): the class with the greatest sum, ties by the smaller label.

    Words are counted per row before they move. A row moves as one record per class:
    classes are few, and a text without known words still has the priors.
    """
    tokens, classes = model
    words = with_tokens(df).select(row_id, F.explode("tokens").alias("token")).groupBy(row_id, "token").agg(F.count(F.lit(1)).alias("n"))
    # Only words seen in training are told apart from unseen ones.
    known = words.join(tokens, "token").groupBy(row_id, "label").agg(F.sum(F.col("n") * F.col("weight")).alias("seen"))
    listed = classes.select(F.collect_list(F.struct("label", "prior", "unseen")).alias("classes")).first()
    rows = with_tokens(df).select(row_id, F.size("tokens").alias("size"))
    if not listed or not listed["classes"]:
        return rows.select(row_id, F.lit(None).cast(classes.schema["label"].dataType).alias("prediction"))
    kind = classes.schema["label"].dataType
    every = rows.select(
        row_id,
        F.explode(F.array(*[F.struct(F.lit(c["label"]).cast(kind).alias("label"), (F.lit(c["prior"]) + F.col("size") * c["unseen"]).alias("base")) for c in listed["classes"]])).alias("c"),
    ).select(row_id, "c.label", "c.base")
    total = F.col("base") + F.coalesce("seen", F.lit(0))
    best = F.min(F.struct((-total).alias("loss"), "label"))["label"]
    return every.join(known, [row_id, "label"], "left").groupBy(row_id).agg(best.alias("prediction"))


# --- small steps, scored after every epoch ----------------------------------------------------

#: Words worked on at once in a task.
MOST_WORDS = 200_000


@dataclass
class EpochModel:
    """Weights of the best epoch, (features + 1) x classes with the bias last, and how every epoch did."""

    labels: list[str]
    weights: np.ndarray
    history: list[tuple[int, float, float]]
    best: int

    @property
    def features(self) -> int:
        return len(self.weights) - 1


def step_rates(steps: int, rate: float, warm_up: float) -> list[float]:
    """Rates that rise over the first share of the steps and fall to zero over the rest, both linearly."""
    rising = max(int(steps * warm_up), 1)
    return [rate * min((t + 1) / rising, (steps - t) / max(steps - rising, 1)) for t in range(steps)]


def word_features(df: DataFrame, features: int) -> Column:
    """Hashed words of a cleaned text, repeated as often as they occur."""
    words = F.filter(F.split(F.coalesce(F.col("text_clean"), F.lit("")), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of rows of bounded length: first and last row, all their features, and words per row."""
    lists = batch.column(batch.schema.get_field_index("features"))
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    flat, first, begin = lists.flatten().to_numpy(zero_copy_only=False), 0, 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, begin + MOST_WORDS, "right")), first + 1)
        end = int(ends[last - 1])
        yield first, last, flat[begin:end], np.diff(ends[first:last], prepend=begin)
        first, begin = last, end


def _scores(weights: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows, the row of every word, and the weight of a word in its row."""
    row, scale = np.repeat(np.arange(len(lengths)), lengths), 1 / np.sqrt(np.maximum(lengths, 1))
    sums = [np.bincount(row, weights[flat, c], len(lengths)) for c in range(weights.shape[1])]
    return np.stack(sums, axis=1) * scale[:, None] + weights[-1], row, scale


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of the gradients over the rows and their number, added up within tasks and then by cell."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, n = np.zeros_like(known), 0
        for batch in batches:
            truth = batch.column(batch.schema.get_field_index("class")).to_numpy(zero_copy_only=False)
            for first, last, flat, lengths in _blocks(batch):
                scores, row, scale = _scores(known, flat, lengths)
                part = np.exp(scores - scores.max(axis=1, keepdims=True))
                part /= part.sum(axis=1, keepdims=True)
                part[np.arange(last - first), truth[first:last]] -= 1
                n += last - first
                total[-1] += part.sum(axis=0)
                for c in range(known.shape[1]):
                    total[:-1, c] += np.bincount(flat, (part[:, c] * scale)[row], len(known) - 1)
        cells = np.flatnonzero(total)
        # The number of rows rides along as a cell of its own.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(total.ravel()[cells], float(n)))], ["cell", "value"])

    sums = rows.mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    shared.unpersist()
    found = dict(zip(sums["cell"].tolist(), sums["value"].tolist()))
    n = int(found.pop(-1, 0))
    gradient = np.zeros(weights.size)
    gradient[list(found)] = list(found.values())
    return gradient.reshape(weights.shape), n


def train_epochs(
    df: DataFrame, development: DataFrame, label: str = "label", epochs: int = 4, batches: int = 8,
    rate: float = 2.0, warm_up: float = 0.1, features: int = 1 << 14,
) -> EpochModel:
    """Multinomial regression on (text_clean, label) by mini-batches; the epoch that does best on ``development`` stays.

    A row is in the batch that a hash of its text tells, so every epoch takes each row
    once. The words are hashed and staged once. The driver holds the weights and, per
    step, one gradient: features x classes. Epochs are compared by weighted F1, then
    accuracy; the earlier one wins ties. Rows without a label are left out.
    """
    labels = [r["label"] for r in df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct().sort("label").collect()]

    def prepared(rows: DataFrame, name: str) -> DataFrame:
        text = F.col(label).cast("string")
        place = F.array_position(F.array(*map(F.lit, labels)).cast("array<string>"), text) - 1
        kept = rows.filter(F.col(label).isNotNull())
        return stage(
            kept.select(
                text.alias("label"), place.cast("int").alias("class"), word_features(kept, features).alias("features"),
                F.pmod(F.xxhash64("text_clean", F.lit("batch")), F.lit(batches)).cast("int").alias("batch"),
            ),
            name,
        )

    rows, held = prepared(df, "epoch-rows"), prepared(development, "development-rows")
    weights = np.zeros((features + 1, max(len(labels), 1)))
    rates, history, best = step_rates(epochs * batches, rate, warm_up), [], None
    for epoch in range(epochs if labels else 0):
        for number in range(batches):
            gradient, n = _gradient(rows.filter(F.col("batch") == number), weights)
            if n:
                weights = weights - rates[epoch * batches + number] / n * gradient
        model = EpochModel(labels, weights, history, epoch + 1)
        done = report(_predicted(model, held), "label", "prediction").first()
        history.append((epoch + 1, done["accuracy"], done["weighted_f1"]))
        if best is None or history[-1][:0:-1] > history[best.best - 1][:0:-1]:
            best = model
    return best or EpochModel(labels, weights, history, 0)


def _predicted(model: EpochModel, rows: DataFrame) -> DataFrame:
    """The rows with ``prediction``: the label with the greatest score, the first one on ties."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.labels))
    kept = [c for c in rows.columns if c != "features"]
    listed = rows.select(*kept, "features")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema if f.name != "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, labels = shared.value
        for batch in batches:
            found = [_scores(weights, flat, lengths)[0].argmax(axis=1) for _, _, flat, lengths in _blocks(batch)]
            best = np.concatenate(found) if found else np.zeros(0, int)
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([labels[k] for k in best], pa.string())], [*kept, "prediction"])

    return listed.mapInArrow(run, f"{schema}, prediction string")


def score_epochs(model: EpochModel, df: DataFrame, row_id: str) -> DataFrame:
    """(row id, prediction) of cleaned texts; null without a label to choose from."""
    rows = df.select(row_id, word_features(df, model.features).alias("features"))
    if not model.labels:
        return rows.select(row_id, F.lit(None).cast("string").alias("prediction"))
    return _predicted(model, rows)


def epoch_table(model: EpochModel, df: DataFrame) -> DataFrame:
    """(epoch, accuracy, weighted_f1, best) on the development part, on the session of a frame."""
    rows = [(n, accuracy, f1, n == model.best) for n, accuracy, f1 in model.history]
    return df.sparkSession.createDataFrame(rows, "epoch int, accuracy double, weighted_f1 double, best boolean")
