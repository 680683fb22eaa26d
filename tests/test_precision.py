import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import linear, subspace
from lotline.operators.gram import factor, gram, grams


@pytest.fixture(scope="module")
def far(spark):
    """Columns a long way from zero: y is 2 x less 1e9 but for their own rounding."""
    r = np.random.default_rng(4)
    a = r.random(20_000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a)], "id long, a double").repartition(4).cache()
    return df, a, {"y": 2 * F.col("a") + 1e9, "x": F.col("a") + 1e9}


def test_columns_far_from_zero(far):
    df, a, cols = far
    x, y = a + 1e9, 2 * a + 1e9
    want = np.linalg.lstsq(np.column_stack([np.ones(len(a)), x - x.mean()]), y - y.mean(), rcond=None)[0][1]
    for f in (linear.fit(gram(df, cols), "y", ["x"]), linear.fit_rows(df, "y", ["x"], cols)):
        assert f.beta[1] == pytest.approx(want, abs=1e-8) and f.r2 == pytest.approx(1, abs=1e-8) and f.n == 20_000
        assert f.beta[1] == pytest.approx(2, abs=1e-6)
    g = gram(df, {"u": F.lit(7.0) + F.col("a"), "x": F.col("a") + 1e9}, F.lit(3.0))
    near = x - 1e9
    assert g.centred(["x"])[0][0, 0] == pytest.approx(3 * ((near - near.mean()) ** 2).sum(), rel=1e-12)
    assert g.of(["u"], ["1"])[0, 0] == pytest.approx(3 * (a + 7).sum(), rel=1e-12)


def test_groups_are_added_and_taken_off(far):
    df, a, cols = far
    parts = grams(df, cols, by=F.col("id") % 5)
    whole = sum(list(parts.values())[1:], list(parts.values())[0])
    g = gram(df, cols)
    assert np.allclose(whole.about, g.about, rtol=1e-9) and np.allclose(whole.mean, g.mean, rtol=1e-15)
    i = np.arange(len(a)) % 5 != 2
    left = whole - parts[2]
    x = (a[i] + 1e9) - 1e9
    assert left.centred(["x"])[0][0, 0] == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-11)
    assert (whole - whole).n == 0


def test_nearly_dependent_columns(spark):
    """Sums of products lose columns that differ by a millionth; triangular factors keep them."""
    r = np.random.default_rng(6)
    u, v = r.standard_normal((2, 4000))
    near = u + 1e-7 * v
    y = u + near + 1e-3 * r.standard_normal(4000)
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(u, near, y)], "u double, near double, y double").repartition(5)
    cols = {c: F.col(c) for c in ("u", "near", "y")}
    f = linear.fit_rows(df, "y", ["u", "near"], cols)
    m = np.column_stack([np.ones(4000), u, near])
    want = np.linalg.lstsq(m, y, rcond=None)[0]
    assert np.allclose(f.beta, want, rtol=1e-6) and f.rss == pytest.approx(((y - m @ want) ** 2).sum(), rel=1e-8)
    assert np.allclose(f.errors()[1:], np.sqrt(np.diag(np.linalg.pinv(m)[1:] @ np.linalg.pinv(m)[1:].T) * f.rss / f.df), rtol=1e-6)
    values, vectors = subspace.randomized_svd(df, {"u": cols["u"], "near": cols["near"]}, 2)
    assert np.allclose(values, np.linalg.svd(np.column_stack([u, near]), compute_uv=False), rtol=1e-7)
    assert np.allclose(vectors.T @ vectors, np.eye(2))
    with pytest.raises(linear.Singular):
        linear.fit(gram(df, cols), "y", ["u", "near"])


def test_singular_columns_are_refused(far, spark):
    df, _, cols = far
    cols = cols | {"twice": 2 * F.col("a"), "one": F.lit(5.0)}
    for bad in (["x", "twice"], ["one"]):
        with pytest.raises(linear.Singular):
            linear.fit(gram(df, cols), "y", bad)
        with pytest.raises(linear.Singular):
            linear.fit_rows(df.where("id < 3000"), "y", [*bad, *(["x"] if bad == ["one"] else [])], {**cols, "x": F.col("a"), "y": F.col("a")})
    none = df.where("id < 0")
    assert gram(none, cols).n == 0
    with pytest.raises(linear.Singular):
        linear.fit(gram(none, cols), "y", ["x"])
    with pytest.raises(linear.Singular):
        linear.fit_rows(none, "y", ["x"], cols)


def test_factor_of_weighted_rows_with_nulls(spark):
    r = np.random.default_rng(9)
    x = r.standard_normal((500, 30))
    w = r.random(500)
    rows = [[float(v) for v in t] + [float(k)] for t, k in zip(x, w)]
    rows[3][7] = None
    rows[5][30] = None
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(30)) + ", w double").repartition(3)
    cols = {f"c{i}": F.col(f"c{i}") for i in range(30)}
    ok = ~np.isin(np.arange(500), [3, 5])
    t, g = factor(df, cols, F.col("w")), gram(df, cols, F.col("w"))
    mean = (x[ok] * w[ok, None]).sum(0) / w[ok].sum()
    about = ((x[ok] - mean).T * w[ok]) @ (x[ok] - mean)
    assert t.n == pytest.approx(w[ok].sum()) and np.allclose(t.mean, mean) and np.allclose(t.r.T @ t.r, about)
    assert np.allclose(g.about[1:, 1:], about) and np.allclose(g.mean[1:], mean) and g.nulls["c7"] == 1 and g.nulls["c6"] == 0
    assert math.isclose(g.n, t.n) and np.allclose(t.singular_values() ** 2, np.sort(np.linalg.eigvalsh(about))[::-1])
