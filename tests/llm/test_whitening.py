import numpy as np
import pytest

from labelloom.llm import whitening
from tests.llm import data


def plain(vectors: np.ndarray, wanted: int = 8):
    """Sums, covariance by centred products, eigenvalues and eigenvectors by the library."""
    x = np.floor(vectors.astype(np.float64) * 1024).astype(np.int64) + 100_000
    centred = x - x.sum(axis=0) / len(x)
    values, found = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1][:wanted], found[:, ::-1][:, :wanted], values.sum()


@pytest.mark.parametrize("kind", ["plain", "repeated", "low rank", "diagonal", "zero", "identity", "graded", "one"])
def test_components_equal_the_library(kind):
    draw = np.random.default_rng(3)
    n = 1 if kind == "one" else 40
    q, _ = np.linalg.qr(draw.standard_normal((n, n)))
    values = {
        "plain": draw.random(n), "repeated": np.repeat([4.0, 2.0, 1.0, 0.5], 10), "low rank": np.r_[np.ones(3) * [3, 2, 1], np.zeros(max(n - 3, 0))],
        "diagonal": np.arange(n) * 1.0, "zero": np.zeros(n), "identity": np.ones(n), "graded": 10.0 ** -np.arange(n), "one": np.array([2.0]),
    }[kind]
    a = np.diag(values) if kind in ("diagonal", "identity") else (q * values) @ q.T
    found, vectors = whitening.principal(a, 8)
    size = np.linalg.norm(a)
    assert np.abs(found - np.sort(values)[::-1][:8]).max() <= 1e-14 * size + 1e-300
    assert np.abs(a @ vectors - vectors * found).max() <= 5e-15 * size + 1e-300
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-14


def test_polar_factor():
    draw = np.random.default_rng(5)
    a = draw.standard_normal((12, 12))
    a = a + a.T
    u, _, v = np.linalg.svd(a)
    assert np.abs(whitening.polar(a) - u @ v).max() < 1e-13


def test_query_equals_plain_version(spark, sf_dir):
    given = data.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").toPandas()
    x, values, found, trace = plain(np.stack(given["embedding"]))
    rows = whitening.op11_whitening(spark, sf_dir).toPandas()
    n = len(x)
    assert len(rows) == 8 * n and set(rows["n"]) == {n}
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    expected = (x - x.sum(axis=0) / n) @ found / np.sqrt(values)
    signs = np.sign((wide * expected).sum(axis=0))
    assert np.abs(wide - expected * signs).max() < 1e-9
    far = {k: sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, x.sum(axis=0))) for k, row in zip(given["vec_id"], x)}
    assert all(far[k] == d for k, d in zip(rows["vec_id"], rows["deviation"]))
    shares = rows.groupby("component")["explained"].first().to_numpy()
    assert np.abs(shares / (values / trace) - 1).max() < 1e-12
    assert rows["identity_error"].nunique() == 1 and 0 <= rows["identity_error"][0] < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    schema = "vec_id long, embedding array<float>, label int, _x string, whitened double, deviation long, n long"
    extra = (1, "x", 0.5, 3, 4)
    draw = np.random.default_rng(1)
    good = [[float(v) for v in draw.standard_normal(3)] for _ in range(20)]
    rows = [(k, v, *extra) for k, v in enumerate(good)] + [(0, good[0], *extra), (None, good[1], *[None] * 5)]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, inf, 2.0], [1.0, 2.0], [-inf] * 3]
    df = spark.createDataFrame(rows + [(100 + k, v, *extra) for k, v in enumerate(bad)], schema)
    model = whitening.fit(df)
    assert model.n == 22 and model.rank == 3 and model.identity_error < 1e-12
    out = whitening.whiten(df, model).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in out) == sorted([-1, 0, *range(20)])
    x, values, found, _ = plain(np.array([r[1] for r in rows], np.float32))
    expected = (x - x.mean(axis=0)) @ found / np.sqrt(values)
    whole = {r.vec_id: np.array(r.whitened) for r in out}
    assert all(np.allclose(np.abs(whole[r[0]]), np.abs(e), atol=1e-9) for r, e in zip(rows, expected))


def test_flat_and_empty_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(k, [1.0, float(k % 2), 3.0]) for k in range(6)], schema)
    model = whitening.fit(same)
    assert model.rank == 1
    for r in whitening.whiten(same, model).collect():
        assert abs(abs(r.whitened[0]) - 1) < 1e-12 and r.whitened[1:] == [None, None]
    flat = whitening.fit(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema))
    assert flat.rank == 0 and flat.identity_error is None
    for k, rows in enumerate([[], [(1, None)], [(1, []), (2, [])]]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.fit(df) is None
        df.write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        assert whitening.op11_whitening(spark, f"{tmp_path}/{k}").collect() == []


def test_large_deviations_are_exact(spark):
    df = spark.createDataFrame([(1, [3e9, -3e9]), (2, [-3e9, 2.0]), (3, [5.0, 7.0])], "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    rows = {r.vec_id: int(r.deviation) for r in whitening.whiten(df, model).collect()}
    x = [[int(np.floor(np.float64(np.float32(c)) * 1024)) + 100_000 for c in v] for v in ([3e9, -3e9], [-3e9, 2.0], [5.0, 7.0])]
    sums = [sum(c) for c in zip(*x)]
    assert rows == {k + 1: sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)}
