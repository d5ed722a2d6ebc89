"""Whitening of embeddings; principal components by QDWH spectral divide and conquer.

Two passes over the vectors give exact sums and the centred covariance, added up
within tasks before the shuffle. The covariance, whose size depends on the dimension
alone, is split on the driver: the polar factor of the covariance minus a shift,
found by the dynamically weighted Halley iteration, is plus one on the eigenvectors
above the shift and minus one on those below. Half of it plus the identity projects on
the invariant subspace above; both subspaces are split again until they are lines.
The components are broadcast, and a narrow pass whitens the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import query, table

EPS = float(np.finfo(np.float64).eps)
#: Fixed point of the entries: factor and offset.
SCALE, OFFSET = 1024, 100_000


# --- eigenvectors ----------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    low = EPS  # a lower bound of the smallest singular value that matters
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if abs(1 - low) < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray, shift: float, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """An orthogonal matrix whose first columns span the eigenvectors above the shift, and their number."""
    n = len(a)
    projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    above = int(round(np.trace(projector)))
    q, _ = np.linalg.qr(projector @ draw.standard_normal((n, n)))
    # Once more: the first columns lose what the projector's rounding left of the other half.
    upper, _ = np.linalg.qr(projector @ q[:, :above])
    full, _ = np.linalg.qr(np.hstack([upper, q[:, above:]]))
    return full, above


def principal(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    a = (a + a.T) / 2
    size, draw = np.linalg.norm(a), np.random.default_rng(7)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # Subspaces still to be split, the one with the largest eigenvalues last.
    waiting = [np.eye(len(a))]
    while waiting and len(values) < wanted:
        basis = waiting.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        n = len(part)
        mean = np.trace(part) / n
        spread = np.linalg.norm(part - mean * np.eye(n))
        if n == 1 or spread <= 4 * EPS * size:
            values += [mean] * n
            vectors += list(basis.T)
            continue
        # The mean lies between the least and the greatest eigenvalue. Where it meets an
        # eigenvalue the halves do not come apart; another shift beside it does.
        best = None
        for step in (0.0, 0.05, -0.05, 0.15, -0.15, 0.3, -0.3):
            q, above = _halves(part, mean + step * spread / np.sqrt(n), draw)
            if 0 < above < n:
                rest = np.linalg.norm(q[:, :above].T @ part @ q[:, above:])
                if best is None or rest < best[0]:
                    best = rest, q, above
                if rest <= 10 * EPS * n * spread:
                    break
        if best is None:
            raise ArithmeticError("the spectrum could not be divided")
        _, q, above = best
        waiting += [basis @ q[:, above:], basis @ q[:, :above]]
    found = np.array(vectors[:wanted]).reshape(-1, len(a)).T
    # Close to orthonormal already; one Newton-Schulz step takes off the rounding of the products.
    found = found @ (1.5 * np.eye(found.shape[1]) - 0.5 * (found.T @ found))
    values = np.einsum("ij,ik,kj->j", found, a, found)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


# --- fit and transform -----------------------------------------------------------------


@dataclass
class Model:
    """What whitening needs; its size depends on the dimension and the number of components alone."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def rank(self) -> int:
        """Components whose variance is more than rounding; the others cannot be scaled to one."""
        top = self.values[0] if len(self.values) else 0.0
        return int(np.sum(self.values > 4 * EPS * len(self.sums) * max(top, 0.0)))


def fixed_point(vector: str | Column) -> Column:
    """Whole numbers ``floor(1024 c) + 100000`` of a vector's entries; null if the vector or an entry is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET))


def _matrices(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as a matrix; all vectors have one length."""
    for batch in batches:
        if batch.num_rows:
            column = batch.column(at)
            yield batch, column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and sums by dimension, for the length that most vectors have (the longer one on a tie)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = np.diff(column.offsets.to_numpy())
            flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            for d in np.unique(lengths):
                rows = starts[lengths == d]
                block = flat[rows[:, None] + np.arange(d)]
                known = sums.setdefault(int(d), [0, np.zeros(d, np.int64)])
                known[0] += len(rows)
                known[1] += block.sum(axis=0)
        for d, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"d": [d], "n": [n], "s": pa.array([total.tolist()], pa.list_(pa.int64()))},
                schema=pa.schema([("d", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]),
            )

    parts = vectors.select("_x").mapInArrow(add, "d int, n long, s array<long>")
    counted = parts.select("d", "n", F.posexplode("s").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = counted.groupBy("d").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("s"))
    row = best.orderBy(F.desc("n"), F.desc("d")).first()
    return (0, np.zeros(0, np.int64)) if row is None else (row.n, np.array([x.s for x in row.s], np.int64))


def _scatter(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' symmetric matrices, given by rows (i, entries from i on)."""
    cells = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    found = cells.toPandas()
    size = int(found["i"].max()) + 1
    out = np.zeros((size, size))
    i, j = found["i"].to_numpy(), found["i"].to_numpy() + found["j"].to_numpy()
    out[i, j] = out[j, i] = found["v"].to_numpy()
    return out


def _upper(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [matrix[i, i:] for i in range(len(matrix))]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["i", "v"])


def _covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance with divisor n. Vectors are centred by the rounded mean, in whole numbers, before multiplying;
    the products of the remainders, each below a half, are taken off."""
    middle = np.array([int(s) // n + (2 * (int(s) % n) >= n) for s in sums], np.int64)
    left = np.array([(int(s) - n * int(m)) / n for s, m in zip(sums, middle)])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, block in _matrices(batches):
            centred = (block - middle).astype(np.float64)
            total = centred.T @ centred + (0 if total is None else total)
        if total is not None:
            yield from _upper(total)

    return _scatter(vectors.select("_x").mapInArrow(multiply, "i int, v array<double>")) / n - np.outer(left, left)


def _whitener(model: Model):
    """Function from a matrix of whole-number vectors to the whitened one, component by component."""
    n, sums, rank = model.n, model.sums, model.rank
    middle = np.array([int(s) // n for s in sums], np.int64)
    left = np.array([(int(s) % n) / n for s in sums])
    scaled = model.vectors[:, :rank] / np.sqrt(model.values[:rank])
    return lambda block: ((block - middle).astype(np.float64) - left) @ scaled


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> Model | None:
    """Sums, covariance and leading components of a column of vectors, and how far the whitened covariance is from the identity.

    Vectors that are null or hold null, NaN or infinite entries are left out; so are
    those whose length is not the one most vectors have. Repeated rows and ties
    count as often as they occur; equal eigenvalues share an arbitrary orthonormal basis.
    None if no vector with an entry is left. The driver holds one square matrix of the
    dimension.
    """
    x = fixed_point(f"`{vector}`")
    vectors = df.select(x.alias("_x")).filter("_x is not null and size(_x) > 0")
    n, sums = _totals(vectors)
    if n == 0:
        return None
    vectors = vectors.filter(F.size("_x") == len(sums))
    v = _covariance(vectors, n, sums)
    values, found = principal(v, min(components, len(sums)))
    model = Model(n, sums, values, found, float(np.trace(v)))
    if not model.rank:
        return model
    shared = df.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whiten, total = _whitener(shared.value), None
        for _, block in _matrices(batches):
            # The sums ride along as one more column of ones.
            w = np.hstack([whiten(block), np.ones((len(block), 1))])
            total = w.T @ w + (0 if total is None else total)
        if total is not None:
            yield from _upper(total)

    moments = _scatter(vectors.mapInArrow(measure, "i int, v array<double>")) / n
    mean = moments[-1, :-1]
    model.identity_error = float(np.abs(moments[:-1, :-1] - np.outer(mean, mean) - np.eye(model.rank)).max())
    return model


def whiten(df: DataFrame, model: Model | None, vector: str = "embedding", keys: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """One row per vector that the model counts: the keys, its exact squared distance from the mean, times n squared, and its whitened components.

    Columns besides the keys are left out, keys may be null or repeated. Components
    without variance are null. Without a model there are no rows.
    """
    named = [F.col(f"`{k}`") for k in keys]
    length = 0 if model is None else len(model.sums)
    vectors = df.select(fixed_point(f"`{vector}`").alias("_x"), *named).filter(F.size("_x") == F.lit(length) if length else F.lit(False))
    key_schema = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        known = shared.value
        project = _whitener(known) if known.rank else None
        reach = max([abs(int(s)) for s in known.sums], default=0)
        for batch, block in _matrices(batches):
            widest = max(abs(int(block.min())), abs(int(block.max()))) * known.n + reach
            exact = block if widest * widest * block.shape[1] < 2**63 else block.astype(object)
            far = ((exact * known.n - known.sums) ** 2).sum(axis=1)
            columns = np.full((len(block), len(known.values)), np.nan)
            if project:
                columns[:, : known.rank] = project(block)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([str(int(x)) for x in far], pa.string()),
                    pa.ListArray.from_arrays(
                        np.arange(len(block) + 1, dtype=np.int32) * columns.shape[1], pa.array(columns.ravel(), from_pandas=True)
                    ),
                ],
                [*keys, "_far", "whitened"],
            )

    made = vectors.mapInArrow(run, f"{key_schema}, _far string, whitened array<double>")
    return made.select(*named, F.col("_far").cast("decimal(38,0)").alias("deviation"), "whitened")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    model = fit(df)
    rows = whiten(df, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [] if model is None or not model.trace > 0 else [float(v) / model.trace for v in model.values]
    explained = F.array(*[F.lit(s) for s in shares]).cast("array<double>")
    return rows.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(0 if model is None else model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(None if model is None else model.identity_error).cast("double").alias("identity_error"),
    )
