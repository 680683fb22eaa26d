import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.functions import special
from lotline.operators import linear, logistic, ordered, series, smooth, subspace
from lotline.operators.gram import gram, grams


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(8)
    n = 600
    x = r.standard_normal((n, 5))
    y = 3 + 2 * x[:, 0] - x[:, 1] + r.standard_normal(n) * (1 + np.abs(x[:, 2]))
    b = (1 / (1 + np.exp(-(0.5 + x[:, 0]))) > r.random(n)).astype(float)
    rows = [(i, float(y[i]), float(b[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, b double, x0 double, x1 double, x2 double, x3 double, x4 double").cache()
    cols = {c: F.col(c) for c in ("y", "x0", "x1", "x2", "x3", "x4")}
    return df, cols, x, y, b


def test_raters(data):
    df, cols, x, y, b = data
    g, terms = gram(df, cols), ["x1", "x2", "x3", "x4"]
    m, _, e = lstsq(x[:, :1], y)
    z = x[:, 1:] - m @ np.linalg.lstsq(m, x[:, 1:], rcond=None)[0]
    ss, beta = (z**2).sum(0), z.T @ e / (z**2).sum(0)
    for weighted, error in ((None, np.sqrt((e**2).mean() / ss)), (linear.weighted_squares(df, g, "y", ["x0"], terms, cols), np.sqrt((e**2) @ z**2) / ss)):
        bound = np.abs(beta) - special.normal_quantile(0.975) * error
        want = {t: v**2 * s for t, v, s in zip(terms, bound, ss) if v > 0}
        got = linear.rate(g, "y", ["x0"], terms, "stepwise", weighted=weighted)
        assert dict(got) == pytest.approx(want) and got[0][0] == "x1"
    p = np.clip(m @ np.linalg.lstsq(m, y, rcond=None)[0], 1e-11, 1 - 1e-11)
    assert linear.weighted_squares(df, g, "y", ["x0"], terms, cols, True) == pytest.approx(dict(zip(terms, (p * (1 - p)) @ z**2)))
    report = linear.coefficients(linear.fit(g, "y", ["x0"]))
    assert [r[0] for r in report] == ["Intercept", "x0"] and report[1][4] < 1e-9


def lstsq(x, y):
    m = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    return m, beta, y - m @ beta


def test_fit_equals_lstsq(data):
    df, cols, x, y, _ = data
    g = gram(df, cols)
    f = linear.fit(g, "y", ["x0", "x1", "x2"])
    m, beta, e = lstsq(x[:, :3], y)
    assert np.allclose(f.beta, beta) and math.isclose(f.rss, e @ e, rel_tol=1e-9)
    assert np.allclose(f.errors(), np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * f.rss / f.df))
    assert np.allclose(linear.sandwich_errors(df, f, cols), np.sqrt(np.diag(f.inverse @ (m.T * e**2) @ m @ f.inverse)), rtol=1e-6)
    shifted = linear.fit(gram(df, {"y": cols["y"], "x": cols["x0"] * 1e-2 + 1e2}), "y", ["x"])
    assert math.isclose(shifted.rss, lstsq(x[:, :1], y)[2] @ lstsq(x[:, :1], y)[2], rel_tol=1e-4)


def test_wide_gram_equals_plain(data):
    df, cols, x, _, _ = data
    many = {f"v{i}": F.col(f"x{i % 5}") * (i + 1) for i in range(20)}
    g = gram(df, many, F.lit(2.0))
    m = np.column_stack([np.ones(len(x)), *(x[:, i % 5] * (i + 1) for i in range(20))])
    assert np.allclose(g.matrix, 2 * m.T @ m)
    parts = grams(df, many, by=F.col("id") % 3)
    assert np.allclose(sum(p.matrix for p in parts.values()), m.T @ m)


def test_tests(data, spark):
    df, cols, x, y, b = data
    g = gram(df, cols)
    t = linear.partial_f(g, "y", ["x0"], ["x1", "x3"])
    e0, e1 = lstsq(x[:, :1], y)[2], lstsq(x[:, [0, 1, 3]], y)[2]
    assert math.isclose(t.f, ((e0 @ e0 - e1 @ e1) / 2) / (e1 @ e1 / (600 - 4)), rel_tol=1e-8) and t.p < 1e-10
    again = gram(df, cols | {"dup": cols["x0"] * 2 + 1})
    assert linear.partial_f(again, "y", ["x0"], ["dup"]).singular
    z = x[:, 2] - lstsq(x[:, :1], x[:, 2])[0] @ lstsq(x[:, :1], x[:, 2])[1]
    assert math.isclose(linear.white_f(df, g, "y", ["x0"], ["x2"], cols).f, (z @ e0) ** 2 / (z**2 @ e0**2), rel_tol=1e-7)
    t, p = linear.bennett(df, gram(df, cols | {"b": F.col("b")}), "b", [], "x0", cols | {"b": F.col("b")})
    assert t > 5 and p < 0.01


def test_duplicated_rows_validate_alike(data):
    df, cols, *_ = data
    both = df.withColumn("est", F.lit(True)).unionByName(df.withColumn("est", F.lit(False)))
    f, cvss = linear.validated(both, "y", ["x0", "x1"], cols, F.col("est"))
    assert math.isclose(f.rss, cvss, rel_tol=1e-9)
    path = linear.cross_validated(df, "y", ["x0", "x1", "x3"], cols, F.col("id") % 5)
    assert path[2]["cvss"] < path[1]["cvss"] < path[0]["cvss"] and path[3]["r2"] >= path[2]["r2"]


def test_selection(data):
    df, cols, *_ = data
    g = gram(df, cols)
    assert {s.term for s in linear.stepwise(g, "y", ["x3", "x1", "x0", "x4"], add=3)} >= {"x0", "x1"}
    assert [c for c, _ in linear.rate(g, "y", [], ["x3", "x1", "x0"])][0] == "x0"
    a = g.of(["x0", "x1", "y"], ["x0", "x1", "y"])
    s = linear.sweep(linear.sweep(a, 0), 1)
    assert np.allclose(s[:2, 2], np.linalg.solve(a[:2, :2], a[:2, 2]))


def test_logistic(data):
    df, _, x, _, b = data
    m = logistic.irls(df, F.col("b"), {"x0": F.col("x0"), "x3": F.col("x3")})
    mat, beta = np.column_stack([np.ones(600), x[:, 0], x[:, 3]]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-mat @ beta))
        beta = beta + np.linalg.solve((mat.T * (p * (1 - p))) @ mat, mat.T @ (b - p))
    assert np.allclose(m["beta"], beta, atol=1e-6)
    g2, p = logistic.likelihood_ratio(m, logistic.irls(df, F.col("b"), {"x3": F.col("x3")}))
    assert g2 > 30 and p < 1e-6


def test_tails():
    assert math.isclose(special.normal_cdf(1.96), 0.9750021, abs_tol=1e-6)
    assert math.isclose(special.t_pvalue(2.228139, 10), 0.05, abs_tol=1e-5)
    assert math.isclose(special.f_pvalue(4.964603, 1, 10), 0.05, abs_tol=1e-5)
    assert math.isclose(special.chi2_pvalue(3.841459, 1), 0.05, abs_tol=1e-6)
    assert math.isclose(special.chi2_pvalue(18.307, 10), 0.05, abs_tol=1e-5)
    assert special.f_pvalue(float("nan"), 1, 10) > 1 and special.f_pvalue(-1, 1, 10) > 1
    assert math.isclose(sum(special.cauchy_shares(0.5, 9)), 0.5)
    assert math.isclose(special.golden_minimum(lambda v: (v - 2) ** 2, 0, 5), 2, abs_tol=1e-6)


def test_pav_and_spline(spark, data):
    cells = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 0.0), (3.0, 1.0, 1.0), (4.0, 2.0, 1.0), (5.0, 1.0, 1.0)], "x double, n double, total double")
    got = [(r["boundary"], r["n"], round(r["mean"], 6)) for r in ordered.pooled(cells).orderBy("boundary").collect()]
    assert got == [(2.0, 3.0, round(1 / 3, 6)), (4.0, 3.0, round(2 / 3, 6)), (5.0, 1.0, 1.0)]
    scores = spark.createDataFrame([(0.5,), (2.5,), (9.0,)], "s double")
    assert [round(r["calibrated"], 6) for r in ordered.calibrated(scores, "s", ordered.pooled(cells)).orderBy("s").collect()] == [round(1 / 3, 6), round(2 / 3, 6), 1.0]
    line = spark.createDataFrame([(float(i), 2.0 * i + (1 if i % 2 else -1)) for i in range(80)], "x double, y double")
    sp = smooth.smoothing_spline(line, "x", "y", 3)
    assert abs(sp.df - 3) < 0.05 and np.abs(sp(np.arange(5, 75.0)) - 2 * np.arange(5, 75.0)).max() < 0.5
    shown = line.select(sp.column(F.col("x")).alias("f"), "x").collect()
    assert np.allclose([r["f"] for r in shown], sp(np.array([r["x"] for r in shown])))


def test_subspace(data):
    df, cols, x, _, _ = data
    names = {k: v for k, v in cols.items() if k != "y"}
    p = subspace.pca(df, names, 2)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values = np.linalg.eigvalsh(z.T @ z / 599)[::-1]
    assert np.allclose(p["values"], values[:2])
    scores = np.array([[r["pc0"], r["pc1"]] for r in subspace.projected(df, names, p).orderBy("id").collect()])
    assert np.allclose(scores, z @ p["loadings"])
    s, _ = subspace.randomized_svd(df, names, 2)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:2], rtol=1e-6)
    assert subspace.kernel_components(df, "id", list(names), 3, rows=100).count() == 600
    turned = subspace.varimax(p["loadings"])
    assert np.allclose((turned**2).sum(), (p["loadings"] ** 2).sum())


def test_series(spark):
    x = np.random.default_rng(1).standard_normal(32)
    for name in ("haar", "daub2", "daub6", "daub10", "daub18"):
        lo = series.low_pass(name)
        assert math.isclose(lo.sum(), math.sqrt(2), rel_tol=1e-6) and math.isclose(lo @ lo, 1, rel_tol=1e-6)
        assert np.allclose(series.inverse_dwt(series.dwt(x, name), name), x, atol=1e-6)
    assert series.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 3])) == 0
    assert math.isclose(series.dtw(np.array([0.0]), np.array([1.0, 2.0])), 1 + 2)
    k = series.kalman(np.full(200, 5.0), 0.01, 1.0)
    assert abs(k[-1, 0] - 5) < 1e-3
    assert series.lempel_ziv("aababcabcd") == 4
    states, _ = series.poisson_path(np.array([1.0] * 20 + [30.0] * 20), np.array([1.0, 30.0]), 0.95)
    assert states.tolist() == [0] * 20 + [1] * 20
    e, y = np.random.default_rng(3).standard_normal(3000), np.zeros(3000)
    for t in range(2, 3000):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + e[t]
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)] + [("b", t, 1.0) for t in range(3)], "series string, t int, x double")
    got = {(r["series"], r["lag"]): r["phi"] for r in series.ar_least_squares(df, "series", "t", "x", 2).collect()}
    c = y - y.mean()
    want = np.linalg.lstsq(np.column_stack([c[1:-1], c[:-2]]), c[2:], rcond=None)[0]
    assert np.allclose([got["a", 1], got["a", 2]], want) and got["b", 1] == got["b", 2] == -7.7
    assert np.allclose(series.yule_walker(np.array([1.0, 0.5])), [0.5])
