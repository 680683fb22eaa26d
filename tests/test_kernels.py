import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import subspace


@pytest.mark.parametrize("name", ["quadratic", "radial", "l2"])
def test_sketch_of_a_kernel_matrix(spark, name):
    """The largest eigenvalues of a matrix of 2,000 x 2,000 that is never stored."""
    r = np.random.default_rng(3)
    x = r.standard_normal((2000, 5)) * [1, 2, 3, 1, 1]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(9999, None, 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double, e double").repartition(3)
    w = np.array([1.0, 0.5, 0.5, 2.0, 1.0]) * 0.1
    values, vectors, keys = subspace.kernel_sketch(df, "id", list("abcde"), 4, name, w, power=6)
    z = (x - x.mean(0)) / x.std(0)
    m = subspace.kernel(name)(z, z, w)
    all_of = np.linalg.eigvalsh(m)
    want = all_of[np.argsort(-np.abs(all_of))[:4]]
    assert keys == list(range(2000)) and np.allclose(values, want, rtol=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8) and np.linalg.norm(m @ vectors[:, 0] - values[0] * vectors[:, 0]) < 1e-3 * abs(values[0])


def test_bounds(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, a double")
    assert subspace.kernel_sketch(df.limit(0), "id", ["a"], 3)[0].tolist() == []
    assert len(subspace.kernel_sketch(df.limit(2), "id", ["a"], 3)[0]) == 2
    monkeypatch.setattr(subspace, "KERNEL_ROWS", 20)
    with pytest.raises(ValueError):
        subspace.kernel_sketch(df, "id", ["a"], 3)


@pytest.mark.parametrize("name", ["linear", "quadratic"])
def test_values_of_a_kernel_matrix_over_any_number_of_rows(spark, monkeypatch, name):
    monkeypatch.setattr(subspace, "KERNEL_ROWS", 20)
    r = np.random.default_rng(3)
    x = np.column_stack([r.standard_normal((600, 3)) * [1, 20, 3] + [0, 5, 1000], np.full(600, 0.1)])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(9999, None, 1.0, 1.0, 1.0), (None, 7.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double").repartition(3)
    z = (x - x.mean(0)) / np.append(x.std(0)[:3], 1.0)
    want = np.sort(np.linalg.eigvalsh(subspace.kernel(name)(z, z)))[::-1][:12]
    assert np.allclose(subspace.kernel_values(df, "id", list("abcd"), 12, name), want, rtol=1e-9, atol=1e-6)
    assert subspace.kernel_values(df.limit(0), "id", ["a"], 3, name).tolist() == []
    assert len(subspace.kernel_values(df.where("id < 2"), "id", ["a"], 3, name)) == 2
    with pytest.raises(ValueError):
        subspace.kernel_values(df, "id", ["a"], 3, "radial")


def test_gaps_between_eigenvalues():
    assert subspace.eigen_gaps(np.array([10.0, 5.0, 4.9, 2.0, 1.0, 1e-6]), 0.9, 1e-4) == [0, 3, 4]
    assert subspace.eigen_gaps(np.array([4.0]), 0.9, 0.1) == [0] and subspace.eigen_gaps(np.array([]), 0.9, 0.1) == []


def test_random_combinations(spark):
    df = spark.createDataFrame([(1.0, 10.0, 100.0)], "a double, b double, c double")
    cols = {c: F.col(c) for c in "abc"}
    made = subspace.random_combinations(cols, 20, 0.5, seed=1)
    row = df.select(*(v.alias(n) for n, v in made.items())).first()
    sums = {s * a + t * b + u * c for a, b, c in [(1, 10, 100)] for s in (-1, 0, 1) for t in (-1, 0, 1) for u in (-1, 0, 1)}
    assert len(made) > 10 and set(row) <= sums and len(set(row)) > 5
    squares = subspace.random_combinations(cols, 20, 0.5, power=2, seed=1)
    assert [v for v in df.select(*squares.values()).first()] == [v * v for v in row]
    few = subspace.random_combinations(cols, 50, 0.9, pairs=True, rows=1, seed=2)
    assert 0 < len(few) < 50 and all(abs(v) <= 11111 for v in df.select(*few.values()).first())
