import math
from collections import Counter
from statistics import NormalDist

import pytest

from lotline.functions import scalar
from lotline.operators import expand, joins, sample, stats


def test_normal_columns(spark):
    df = spark.createDataFrame([(0.0,), (1.96,), (-3.5,), (None,)], "x double")
    rows = df.select("x", scalar.normal_cdf("x").alias("p"), scalar.normal_quantile(scalar.normal_cdf("x")).alias("q")).collect()
    for r in rows:
        if r["x"] is None:
            assert r["p"] is None and r["q"] is None
        else:
            assert math.isclose(r["p"], NormalDist().cdf(r["x"]), rel_tol=1e-12) and math.isclose(r["q"], r["x"], abs_tol=1e-9)
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "p double").select(scalar.normal_quantile("p")).collect()] == [None] * 3


def test_proportional_sample(spark):
    df = spark.range(1001).repartition(5)
    some = {r["id"] for r in sample.proportional_sample(df, "id", 0.3).collect()}
    assert len(some) == 300 == len({r["id"] for r in sample.proportional_sample(df, "id", 0.3).collect()} & some)
    assert {r["id"] for r in sample.proportional_sample(df, "id", 0.6).collect()} > some
    assert sample.proportional_sample(df, "id", 0.0).count() == 0 and sample.proportional_sample(df.limit(0), "id", 0.5).count() == 0


def test_profile_of_columns_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 0, None), (1.0, 1, None), (None, 1, None)], "a double, b int, c double")
    got = {r["name"]: r for r in stats.profile(df, ["a", "b", "c"]).collect()}
    assert (got["a"]["n_unique"], got["a"]["is_constant"], got["a"]["average"]) == (1, True, 1.0)
    assert got["b"]["is_dummy"] and math.isclose(got["b"]["average"], 2 / 3) and got["c"]["n_unique"] == 0 and got["c"]["least"] is None


def test_choices_and_keywords(spark):
    answers = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "b"), ("q2", None)], "item string, choice string")
    assert {(r["item"], r["choice"]): round(r["percent"], 3) for r in stats.item_choices(answers, "item", "choice").collect()} == {("q1", "a"): 66.667, ("q1", "b"): 33.333, ("q2", None): 100.0}
    docs = spark.createDataFrame([("b a, a c",), ("c",)], "text string")
    assert [tuple(r) for r in expand.keywords(docs, "text", 0).collect()] == [("a", 2), ("c", 2), ("b", 1)]
    assert [r["word"] for r in expand.keywords(docs, "text", 0, 1).collect()] == ["a"]


@pytest.mark.parametrize("part", [7, 4096])
def test_all_pairs_of_any_number_of_rows(spark, monkeypatch, part):
    monkeypatch.setattr(joins, "PAIR_ROWS", part)
    monkeypatch.setattr(joins, "PAIR_STEP", 16)
    rows = [(i - 20, [math.sin(i * k) for k in range(5)]) for i in range(60)]
    rows += [(3, [1.0] * 5), (3, [2.0] * 5), (None, [1.0] * 5), (90, None), (91, [1.0, None, 2.0, 0.0, 1.0]), (92, [1.0]), (93, []), (94, []), (95, [math.inf] + [0.0] * 4)]

    def kernel(x, y):
        if x is None or y is None or len(x) != len(y) or None in x or None in y:
            return "null"
        total = 0.0
        for u, v in zip(x, y):
            total += u * v
        return str((total + 2) * (total + 2))

    want = Counter((i, j, kernel(x, y)) for i, x in rows for j, y in rows if i is not None and j is not None and i <= j)
    found = joins.quadratic_pairs(spark.createDataFrame(rows, "id long, x array<double>").repartition(3), "id", "x").collect()
    assert Counter((r["i"], r["j"], "null" if r["kernel"] is None else str(r["kernel"])) for r in found) == want
    assert joins.quadratic_pairs(spark.createDataFrame([], "id long, x array<double>"), "id", "x").collect() == []
