import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.plans import auction as A
from lotline.plans import features as X
from lotline.plans import streams as S


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((800, 6))
    y = 2 * x[:, 0] + 3 * x[:, 1] * x[:, 2] + 0.3 * r.standard_normal(800)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(800)], "id long, y double, " + ", ".join(f"x{j} double" for j in range(6))).cache()
    return df, X.base_features(df, [f"x{j}" for j in range(6)])


def test_names_and_centres(data):
    _, base = data
    a, b = base[0], base[1]
    p = X.interaction(X.interaction(a, b), a)
    assert p.name == "x0^2*x1" and p.degree == 3 and X.is_derived(p)
    assert X.power_of(a, 3).name == "x0^3" and [f.name for f in X.powers_of(a, 3)] == ["x0^2", "x0^3"]
    assert X.related(X.interaction(a, b), a) and not X.related(a, b)
    d1, d2 = (X.Feature(n, F.lit(1.0), {"parent": "p", "category": n}) for n in "ab")
    assert X.same_parent_levels(d1, d2) and not X.same_parent_levels(d1, d1)
    assert X.joined_attrs({"s": "b"}, {"s": "a", "t": "1"}) == {"s": "a_x_b", "t": "1"}


def test_streams(data):
    _, base = data
    names = lambda s: [b[0].name for b in iter(s.pop, None)]
    assert names(S.cyclic("c", base, {"x1"})) == ["x0", "x2", "x3", "x4", "x5"]
    assert len(names(S.interactions("i", base))) == 21 and len(names(S.interactions("i", base, squares=False))) == 15
    assert names(S.queue("q", base, lambda f: int(f.name[1]))) == ["x5", "x4", "x3", "x2", "x1", "x0"]
    growing = [base[0]]
    s = S.growing("g", growing)
    assert s.pop()[0].name == "x0" and s.pop() is None
    growing.append(base[3])
    assert s.pop()[0].name == "x3"
    assert [len(b) for b in iter(S.bundles("b", base, 4).pop, None)] == [4, 2]
    left, right = [base[0]], [base[1]]
    c = S.cross_product("x", left, right)
    assert c.pop()[0].name == "x0*x1" and c.pop() is None
    right.append(base[2])
    assert c.remaining() == 1 and c.pop()[0].name == "x0*x2"


def test_bids():
    h = A.History()
    assert A.finite_bid(0.5, 10, h) == 0.05 and A.finite_bid(9, 2, h) == 0.25 and A.finite_bid(1, 0, h) == 0
    h.note(False)
    assert A.universal_bid(1.0, 5, h) < A.universal_bid(1.0, 5, A.History())
    assert A.geometric_bid(0.25)(0.4, 3, h) == 0.1


def test_finds_planted_signal(spark, data):
    df, base = data
    model = A.Model(df, F.col("y"), F.col("id") % 4 != 0)
    auction = A.Auction(model, [A.Expert("main", 0.6, A.bounded_universal_bid, S.cyclic("main", base, set())), A.Expert("products", 0.4, A.finite_bid, S.interactions("products", base), "scavenger")])
    auction.run(60)
    assert {"x0", "x1*x2"} <= set(model.names) and len(model.names) <= 12
    log = auction.progress(spark)
    assert log.where("accepted").count() == len(model.names) and log.count() == len(auction.log)
    assert any(e.name.startswith("Cross[") for e in auction.experts) or auction.recovered >= 0
    assert model.passes < len(auction.log)
    last = auction.log[-1]
    assert last["cvss"] < 0.1 * auction.log[0]["cvss"]
    terms = json.loads(json.dumps(A.saved(model)))
    fitted = A.restored(terms, {f.name: f for f in base})
    rss = df.where("id % 4 <> 0").agg(F.sum((F.col("y") - fitted) ** 2)).first()[0]
    assert abs(rss - model.fit().rss) < 1e-6 * rss


def test_forced_and_singular(data):
    df, base = data
    model = A.Model(df, F.col("y"))
    auction = A.Auction(model, [])
    auction.force([base[5], X.unary("twice", lambda c: 2 * c, base[5])])
    assert model.names == ["x5"] and [r["singular"] for r in auction.log] == [False, True]
    assert not auction.round()


def test_calibration_finds_curvature_and_is_saved(spark, data):
    """A response that is curved in the fit is straightened by powers of the fit, which a saved model keeps."""
    df, base = data
    curved = df.withColumn("y", F.col("x0") * 2 + F.col("x0") * F.col("x0") * 3)
    model = A.Model(curved, F.col("y"))
    auction = A.Auction(model, [A.Expert("main", 0.6, A.bounded_universal_bid, S.cyclic("main", base, model.in_model)), A.Expert("cal", 1e-4, A.fixed_bid(A.CALIBRATION_BID), S.calibrations("cal", model.fitted_powers), "calibrate")])
    auction.run(12)
    assert any(n.startswith("Y_hat_") for n in model.names) and len(set(model.names)) == len(model.names)
    fitted = A.restored(json.loads(json.dumps(A.saved(model))), {f.name: f for f in base})
    rss = curved.agg(F.sum((F.col("y") - fitted) ** 2)).first()[0]
    assert abs(rss - model.fit().rss) < 1e-6 * max(rss, 1)


def test_more_streams(data):
    _, base = data
    tagged = [X.Feature(f.name, f.column, {"stream": "AA" if i < 2 else "AB"}, f.powers) for i, f in enumerate(base[:4])]
    names = lambda s: [b[0].name for b in iter(s.pop, None)]
    assert sorted(names(S.cross_by_prefix("x", tagged, "AA", "AB"))) == ["x0*x2", "x0*x3", "x1*x2", "x1*x3"]
    terms = base[:2]
    s = S.models("m", terms)
    assert names(s) == ["x0", "x1"]
    terms.append(base[4])
    assert s.peek()[0].name == "x4" and not A.Expert("e", 1.0, A.finite_bid, s).finished()
    seen: set[str] = set()
    c = S.cyclic("c", base, seen)
    assert len(c.ahead(3)) == 3
    seen |= {"x0", "x1"}
    assert c.pop()[0].name == "x2" and c.remaining() == 4
    near = S.neighborhoods("n", base[:2], lambda f: X.Feature(f"{f.name}[near]", f.column))
    assert names(near) == ["x0[near]", "x1[near]"]
    h = A.History()
    bid = A.after_acceptance_bid(0.01)
    assert bid(1.0, 3, h) == 0.0
    h.note(True)
    assert bid(1.0, 3, h) == 0.01
