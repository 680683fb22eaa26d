import json
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import smooth
from lotline.plans import auction as A
from lotline.plans import features as X
from lotline.plans import streams as S


def dense(x, y, w, lam):
    """(W + lam K)^-1 W y with all matrices written out."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = [1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    return np.linalg.solve(np.diag(w) + lam * q @ np.linalg.solve(r, q.T), np.diag(w))


@pytest.mark.parametrize("n", [3, 4, 5, 60])
def test_banded_spline_equals_the_dense_one(n):
    r = np.random.default_rng(n)
    x, y, w = np.sort(r.random(n)) * 10, r.standard_normal(n), r.random(n) + 0.2
    sp = smooth.Spline(np.column_stack([x, y, w]), min(5, n - 0.5))
    s = dense(x, y, w / w.mean(), sp.lam)
    assert np.allclose(s @ y, sp.fit, atol=1e-6) and np.allclose(np.diag(s), sp.leverage, atol=1e-6)
    assert abs(sp.df - min(5, n - 0.5)) < 1e-4
    again = smooth.Spline.restored(json.loads(json.dumps(sp.stored())))
    at = np.linspace(-1, 11, 40)
    assert np.allclose(again(at), sp(at)) and np.allclose(sp(x), sp.fit)


def test_few_knots():
    assert smooth.Spline(np.array([[1.0, 5.0, 1.0]]), 5)(np.array([0.0, 9.0])).tolist() == [5.0, 5.0]
    assert smooth.Spline(np.array([[1.0, 5.0, 1.0], [3.0, 9.0, 2.0]]), 5)(np.array([2.0])).tolist() == [7.0]


def test_many_knots_take_seconds():
    x = np.arange(1000.0)
    began = time.process_time()
    sp = smooth.Spline(np.column_stack([x, np.sin(x / 100), np.ones(1000)]), 12)
    assert time.process_time() - began < 5 and np.abs(sp.fit - np.sin(x / 100)).max() < 0.1


@pytest.mark.parametrize("squares", [True, False])
def test_pairs_are_told_from_their_numbers(squares):
    for p in (1, 2, 3, 7, 20):
        want = [(i, j) for i in range(p) for j in range(i if squares else i + 1, p)]
        assert [S.pair_at(k, p, squares) for k in range(S.pair_count(p, squares))] == want


def test_a_hundred_thousand_features():
    """Neither the pairs of many features nor how many are left need a list."""
    many = [X.Feature(f"x{i}", None, {}, ((f"x{i}", 1),)) for i in range(100_000)]
    quick = lambda a, b: X.Feature(f"{a.name}*{b.name}", None)
    keep, S.interaction = S.interaction, quick
    tracemalloc.start()
    began = time.process_time()
    try:
        s, c = S.interactions("i", many), S.cross_product("c", many[:50_000], many[50_000:])
        for stream, total in ((s, 5_000_050_000), (c, 2_500_000_000)):
            assert stream.peek() and stream.remaining() == total
            got = [stream.pop()[0].name for _ in range(1000)]
            assert len(set(got)) == 1000 and stream.peek() and stream.remaining() == total - 1000
        later = S.interactions("i", many, start=5_000_000_000)
        assert later.pop() and later.remaining() == 50_000
    finally:
        S.interaction = keep
    assert time.process_time() - began < 3 and tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()


def test_cross_products_while_lists_grow(spark):
    f = [X.Feature(n, F.lit(1.0), {}, ((n, 1),)) for n in "abcdef"]
    left, right = f[:2], [f[1], f[2]]
    s = S.cross_product("x", left, right)
    names = lambda: [b[0].name for b in iter(s.pop, None)]
    assert s.peek() and s.remaining() == 4 and names() == ["a*b", "a*c", "b*c"] and s.remaining() == 0
    right.append(f[3])
    left.append(f[4])
    assert s.remaining() == 5 and names() == ["a*d", "b*d", "b*e", "c*e", "d*e"] and s.pop() is None


@pytest.fixture(scope="module")
def curved(spark):
    r = np.random.default_rng(5)
    x = r.uniform(-2, 2, (900, 3))
    y = np.abs(x[:, 0] + x[:, 1]) * 3 + 0.05 * r.standard_normal(900) + x[:, 0] + x[:, 1]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(900)], "id long, y double, x0 double, x1 double, x2 double").cache()
    return df, X.base_features(df, ["x0", "x1", "x2"])


def test_spline_calibration_in_the_search(curved):
    """A kink in the fit is found by the spline of the residuals; a saved model has it again, and can be refitted."""
    df, base = curved
    model = A.Model(df, F.col("y"), F.col("id") % 5 != 0)
    auction = A.Auction(model, [A.Expert("main", 0.6, A.bounded_universal_bid, S.cyclic("main", base, model.in_model)), A.Expert("cal", A.CALIBRATION_WEALTH, A.fit_bid(A.CALIBRATION_BID), S.calibrations("cal", model.fitted_spline, lambda: len(model.terms), gap=2), "calibrate")])
    auction.run(12)
    assert any(n.startswith("Y_hat_spline_") for n in model.names)
    won = [r["accepted"] for r in auction.log]
    assert all(won[i - 1] and auction.log[i - 1]["expert"] != "cal" for i, r in enumerate(auction.log) if r["expert"] == "cal")
    terms = json.loads(json.dumps(A.saved(model)))
    by_name = {f.name: f for f in base}
    fitted = A.restored(terms, by_name)
    rss = df.where("id % 5 <> 0").agg(F.sum((F.col("y") - fitted) ** 2)).first()[0]
    f = model.fit()
    assert abs(rss - f.rss) < 1e-6 * rss and rss < 0.2 * f.tss
    twice = A.refitted(df.where("id % 5 <> 0"), 2 * F.col("y"), terms, by_name)
    assert np.allclose(twice.beta, 2 * f.beta, rtol=1e-6, atol=1e-8)
    assert np.allclose([t["beta"] for t in A.reweighted(terms, twice)], 2 * f.beta, rtol=1e-6, atol=1e-8)


def test_candidates_with_nulls_are_refused(curved):
    df, base = curved
    holes = df.withColumn("x2", F.when(F.col("id") % 7 != 0, F.col("x2")))
    model = A.Model(holes, F.col("y"))
    with pytest.raises(ValueError, match="x2"):
        model.measure(base)


def test_threaded_passes_give_the_same_log(spark):
    """Many candidates, so that several passes are needed: rounds decide alike, and most passes were begun before they were needed."""
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 14))
    y = x[:, 0] + 2 * x[:, 3] * x[:, 5] + 0.2 * r.standard_normal(400)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(400)], "id long, y double, " + ", ".join(f"x{j} double" for j in range(14))).cache()
    base = X.base_features(df, [f"x{j}" for j in range(14)])

    def search(threaded):
        model = A.Model(df, F.col("y"))
        experts = [A.Expert("main", 0.4, A.bounded_universal_bid, S.cyclic("main", base, model.in_model)), A.Expert("products", 0.6, A.finite_bid, S.interactions("products", base)), A.Expert("cal", A.CALIBRATION_WEALTH, A.fit_bid(A.CALIBRATION_BID), S.calibrations("cal", model.fitted_powers), "calibrate")]
        return A.Auction(model, experts, threaded).run(110)

    plain, ahead = search(False), search(True)
    assert [(r["expert"], r["feature"], r["accepted"]) for r in plain.log] == [(r["expert"], r["feature"], r["accepted"]) for r in ahead.log] and len(plain.log) > 60
    assert np.allclose([r["p"] for r in plain.log], [r["p"] for r in ahead.log], atol=1e-9) and "x3*x5" in plain.model.names
    assert ahead.ahead.used > 0 and ahead.ahead.thread is None


def test_tables_are_cleared(spark):
    from lotline import storage

    a, b = storage.written(spark.range(5), "kept"), storage.written(spark.range(6), "gone")
    storage.forget(b)
    assert a.count() == 5 and storage.clear(spark) >= 1 and storage.clear(spark) == 0
    with pytest.raises(Exception):
        a.count()
