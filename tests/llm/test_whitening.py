import math
import random

import numpy as np
import pytest

from lodescan.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"


def slow(vectors):
    """(x, n, sums, eigenvalues, eigenvectors) by numpy over the distinct vectors."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    u = np.unique(x, axis=0)
    c = u - u.mean(axis=0)
    w, q = np.linalg.eigh(c.T @ c / len(u))
    return x, u, w[::-1], q[:, ::-1]


def check(found, ids, vectors, components=16):
    x, u, w, q = slow(vectors)
    n, sums = len(u), u.sum(axis=0)
    kept = min(components, int((w > 1e-9 * w[0]).sum()))
    at = {(r["vec_id"], r["component"]): r for r in found}
    assert len(at) == len(found) == len(ids) * kept
    z = np.array([[at[i, k]["whitened"] for k in range(1, kept + 1)] for i in ids])
    explained = np.array([at[ids[0], k]["explained"] for k in range(1, kept + 1)])
    assert np.allclose(explained, w[:kept] / w.sum(), rtol=1e-9)
    for i, row in zip(ids, x):
        assert at[i, 1]["n"] == n
        assert at[i, 1]["deviation"] == sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums))
    assert all(r["identity_error"] < 1e-9 for r in found)
    # coordinates agree up to one sign a component where eigenvalues are apart
    wanted = (x - u.mean(axis=0)) @ q[:, :kept] / np.sqrt(w[:kept])
    for k in range(kept):
        gaps = [abs(w[k] - w[o]) for o in (k - 1, k + 1) if 0 <= o < len(w)]
        if min(gaps, default=1) > 1e-3 * w[0]:
            sign = 1 if wanted[:, k] @ z[:, k] > 0 else -1
            assert np.allclose(sign * z[:, k], wanted[:, k], atol=1e-9)
    # and give the covariance of the components in any case
    _, first = np.unique(x, axis=0, return_index=True)
    part = z[first] - z[first].mean(axis=0)
    assert np.allclose(part.T @ part / n, np.eye(kept), atol=1e-9)


def test_generated_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    check(W.whitened(table).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("shape", ["copies", "low rank", "equal deviations", "fewer vectors than dimensions"])
def test_odd_spectra(spark, shape):
    draw = np.random.default_rng(4)
    if shape == "copies":  # a third of the rows are one vector
        base = draw.standard_normal((40, 6)) * [9, 5, 3, 2, 1, 0.5]
        vectors = np.concatenate([base, np.repeat(base[:1], 20, axis=0)])
    elif shape == "low rank":
        vectors = draw.integers(-30, 30, (50, 3)) @ draw.integers(-3, 3, (3, 8))
    elif shape == "equal deviations":  # every direction has the same
        vectors = np.concatenate([np.eye(5), -np.eye(5)]) * 3
    else:
        vectors = draw.standard_normal((5, 12)) * 4
    vectors = vectors.astype(np.float32).tolist()
    ids = list(range(len(vectors)))
    table = spark.createDataFrame(list(zip(ids, vectors)), SCHEMA)
    check(W.whitened(table).collect(), ids, vectors)


def test_the_bidiagonal_form(spark):
    """X V = U B with V at right angles and B upper bidiagonal, whatever numpy says of X."""
    draw = np.random.default_rng(8)
    vectors = (draw.standard_normal((60, 7)) * 5).astype(np.float32).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), SCHEMA)
    fit = W.fit_list(W.whole_vectors(table, "vec_id", "embedding"))
    v, b, square = W.bidiagonalise(fit)
    u = np.unique(slow(vectors)[0], axis=0)
    x = u - u.mean(axis=0)
    assert np.allclose(v.T @ v, np.eye(7), atol=1e-12)
    assert np.count_nonzero(b - np.diag(np.diag(b)) - np.diag(np.diag(b, 1), 1)) == 0
    assert np.allclose((x @ v).T @ (x @ v), b.T @ b, atol=1e-8)
    assert math.isclose(square, (x * x).sum(), rel_tol=1e-12)


def test_odd_rows(spark):
    draw = random.Random(2)
    good = [(i % 30, [draw.uniform(-2, 2) for _ in range(3)]) for i in range(40)] + [(None, [0.5, 0.5, 0.5])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan")] * 3), (94, [float("inf"), 1.0, 1.0]),
           (95, [1.0, 2.0]), (96, [3e38, 0.0, 0.0])]
    table = spark.createDataFrame(good + bad, SCHEMA).selectExpr(
        "*", "'a' as x", "'b' as n", "'c' as component", "'d' as length", "'e' as count")
    found = W.whitened(table).collect()
    assert len(found) == 3 * len(good)
    assert {r["n"] for r in found} == {41}
    assert {r["vec_id"] for r in found} == {r[0] for r in good}


def test_tables_without_a_deviation(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    for table in (one, one.limit(0), one.selectExpr("vec_id", "cast(null as array<float>) as embedding")):
        found = W.whitened(table)
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.collect() == []


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 50, 0], [-(1 << 50), 0]])
    assert W._deviation(x, 2, np.array([0, 0], object)) == [None, None]
    x = np.array([[1 << 30, 0], [-(1 << 30), 0]])
    assert W._deviation(x, 1, np.array([0, 0], object)) == [1 << 60, 1 << 60]
