import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.functions.special import chi2_pvalue
from lotline.operators import linear, logistic, sweeps
from lotline.operators.gram import Gram, gram


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(12)
    n = 1500
    x = r.standard_normal((n, 8))
    p = 1 / (1 + np.exp(-(-0.3 + 1.2 * x[:, 0] - 0.8 * x[:, 1] + 0.5 * x[:, 2])))
    b = (r.random(n) < p).astype(float)
    y = 1 + 2 * x[:, 0] - x[:, 3] + r.standard_normal(n) * (0.5 + np.abs(x[:, 4]))
    df = spark.createDataFrame([(i, float(b[i]), float(y[i]), *map(float, x[i])) for i in range(n)], "id long, b double, y double, " + ", ".join(f"x{j} double" for j in range(8))).repartition(4).cache()
    return df, x, b, y


def newton(m, b):
    beta = np.zeros(m.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-m @ beta))
        beta = beta + np.linalg.solve((m.T * (p * (1 - p))) @ m, m.T @ (b - p))
    p = 1 / (1 + np.exp(-m @ beta))
    return beta, float(np.log(np.where(b == 1, p, 1 - p)).sum())


@pytest.mark.parametrize("protection", [0, 1])
def test_screens_judge_as_full_refits_do(data, protection):
    """What is kept and what isn't is what refits with and without each candidate say; a rejected one leaves no trace."""
    df, x, b, _ = data
    model = logistic.Screened(df, F.col("b"), protection)
    added = model.consider({f"x{j}": F.col(f"x{j}") for j in range(8)}, 0.001)
    assert set(added) == {"x0", "x1", "x2"} == set(model.terms)
    one = np.ones((len(b), 1))
    at = [int(t[1]) for t in model.terms]
    beta, loglik = newton(np.hstack([one, x[:, at]]), b)
    assert np.allclose(model.fit["beta"], beta, atol=1e-5) and math.isclose(model.fit["loglik"], loglik, rel_tol=1e-8)
    for j in set(range(8)) - set(at):
        assert chi2_pvalue(2 * (newton(np.hstack([one, x[:, [*at, j]]]), b)[1] - loglik), 1) > 0.001
    for j in at:
        rest = [k for k in at if k != j]
        assert chi2_pvalue(2 * (loglik - newton(np.hstack([one, x[:, rest]]), b)[1]), 1) <= 0.001
    before = model.fit["beta"].copy(), dict(model.terms)
    assert not model.tried("noise", F.rand(3) * 0 + F.col("x6"), 1e-6)
    assert (model.fit["beta"] == before[0]).all() and model.terms.keys() == before[1].keys() and not model.log[-1]["kept"]
    assert model.consider({"twice": 2 * F.col("x0")}, 0.05) == [] and model.consider({}, 0.05) == []


def test_one_pass_screen_is_the_score_test(data):
    df, x, b, _ = data
    model = logistic.Screened(df, F.col("b"))
    model.tried("x0", F.col("x0"), 0.05)
    tests = model.tests({"x1": F.col("x1"), "x5": F.col("x5")})
    for c in ("x1", "x5"):
        s, p = logistic.score_test(df, F.col("b"), {"x0": F.col("x0")}, model.fit["beta"], F.col(c))
        assert tests[c].f == pytest.approx(s, rel=0.15, abs=0.05) and tests[c].p == pytest.approx(p, rel=0.6, abs=0.02)


def test_protection_of_linear_models(data):
    df, x, b, y = data
    cols = {c: F.col(c) for c in ("y", *(f"x{j}" for j in range(8)))}
    g = gram(df, cols)
    assert linear.add_if_useful(df, g, "y", ["x0"], ["x3"], cols, 0.001)[0]
    # the variance of y grows with |x4|: a plain F of x4 x noise may pass where White's does not
    for p in (0, 1):
        kept, t = linear.add_if_useful(df, g, "y", ["x0", "x3"], ["x6"], cols, 0.01, p)
        assert kept == (t.p <= 0.01)
    assert not linear.add_if_useful(df, g, "y", ["x0"], ["x0"], cols, 0.5)[0]


def test_swept_steps_equal_refits(data):
    df, x, _, y = data
    cols = {c: F.col(c) for c in ("y", *(f"x{j}" for j in range(8)))} | {"dup": F.col("x0") + F.col("x3"), "one": F.lit(2.0)}
    g = gram(df, cols)
    names = [f"x{j}" for j in range(8)] + ["dup", "one"]
    s = sweeps.Swept(g, "y", names)
    steps, xs = s.expand(4), []
    for step in steps:
        tests = {c: linear.partial_f(g, "y", xs, [c]) for c in names if c not in xs}
        best = max((t.f, c) for c, t in tests.items() if not t.singular)
        assert step.term == best[1] and step.f == pytest.approx(best[0], rel=1e-7) and step.limit == 2 * math.log(10)
        xs.append(step.term)
    enter = s.enter()
    assert "one" not in enter and all(enter[c] == pytest.approx(linear.partial_f(g, "y", xs, [c]).f, rel=1e-6, abs=1e-9) for c in enter)
    leave = s.leave()
    assert all(leave[c] == pytest.approx(linear.partial_f(g, "y", [k for k in xs if k != c], [c]).f, rel=1e-6) for c in xs)
    state, m = s.state(), s.m.copy()
    gone = s.trim(2, (xs[0],))
    assert gone[0] == min((f, c) for c, f in leave.items() if c != xs[0])[1] and len(s.terms) == 2
    assert s.fit().rss / s.fit().tss == pytest.approx(s.rss, rel=1e-9)
    for c in gone[::-1]:
        s.add(c)
    assert np.allclose(s.m, m, atol=1e-9)
    s.restore(state)
    assert s.terms == state[1] and (s.m == m).all()


def test_two_thousand_candidates():
    r = np.random.default_rng(2)
    x = r.standard_normal((3000, 2001))
    x[:, 0] += x[:, 5] * 2 + x[:, 9]
    mean = x.mean(0)
    about = np.zeros((2002, 2002))
    about[1:, 1:] = (x - mean).T @ (x - mean)
    g = Gram(["1", "y", *(f"c{i}" for i in range(1, 2001))], 3000.0, np.append(1.0, mean), about, np.zeros(2002))
    began = time.time()
    steps = linear.stepwise(g, "y", [f"c{i}" for i in range(1, 2001)], add=25)
    assert time.time() - began < 5 and [s.term for s in steps[:2]] == ["c5", "c9"] and len(steps) == 25


def test_four_covariances(data):
    df, x, b, y = data
    cols = {"b": F.col("b"), "x0": F.col("x0"), "x1": F.col("x1"), "w": F.lit(0.5) + F.abs(F.col("x4"))}
    m = np.column_stack([np.ones(len(b)), x[:, :2]])
    f = linear.fit(gram(df, {k: cols[k] for k in ("b", "x0", "x1")}), "b", ["x0", "x1"])
    inv = np.linalg.inv(m.T @ m)
    fit = m @ (inv @ m.T @ b)
    e, p = b - fit, np.clip(fit, 1e-11, 1 - 1e-11)
    want = {"raw": inv * (e @ e) / f.df, "binomial": inv @ (m.T * (p * (1 - p))) @ m @ inv, "hetero": inv @ (m.T * e**2) @ m @ inv}
    for kind, v in want.items():
        assert np.allclose(sweeps.covariance(df, f, cols, kind), v, rtol=1e-6)
    w = 0.5 + np.abs(x[:, 4])
    fw = linear.fit(gram(df, {k: cols[k] for k in ("b", "x0", "x1")}, cols["w"]), "b", ["x0", "x1"])
    iw = np.linalg.inv((m.T * w) @ m)
    assert np.allclose(sweeps.covariance(df, fw, cols, "homo", cols["w"]), fw.rss / fw.df * iw @ (m.T * w**2) @ m @ iw, rtol=1e-6)
    with pytest.raises(ValueError):
        sweeps.covariance(df, f, cols, "other")
