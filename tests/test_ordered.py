import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import gram, ordered, series


@pytest.mark.parametrize("size", ["64m", "1k"])
def test_row_numbers_under_adaptive_execution(spark, size):
    """Every number once, in order, however Spark joins partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("k"), F.lit("x" * 50).alias("wide"))
        got = [(r["k"], r["row"]) for r in ordered.row_numbers(df, ["k"]).select("k", "row").collect()]
        assert [n for _, n in sorted(got)] == list(range(40_000))
        tied = ordered.row_numbers(df.withColumn("k", F.col("k") % 3), ["k"])
        assert tied.agg(F.count_distinct("row"), F.max("row")).first() == (40_000, 39_999)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def isotonic(rows):
    """One stack over all cells."""
    merged: dict[float, list[float]] = {}
    for x, n, t in rows:
        a = merged.setdefault(x, [0.0, 0.0])
        a[0] += n
        a[1] += t
    out = []
    for x, (n, t) in sorted(merged.items()):
        while out and out[-1][2] * n >= t * out[-1][1]:
            _, n0, t0 = out.pop()
            n, t = n + n0, t + t0
        out.append((x, n, t))
    return out


@pytest.mark.parametrize("ranges", [1, 2, 3, 8, 9])
@pytest.mark.parametrize("kind", ["noisy", "rising", "falling"])
def test_pooling_in_ranges(spark, monkeypatch, ranges, kind):
    """Any number of ranges gives what one stack gives; rising cells stay as they are, falling ones are one block."""
    if kind != "noisy" and ranges != 3:
        pytest.skip("covered by the noisy cells")
    r = np.random.default_rng(ranges)
    cells = [(float(x), 1.0, {"noisy": float(r.random() < (x % 100) / 150 + x / 900), "rising": float(x), "falling": -float(x)}[kind]) for x in r.permutation(400)]
    cells += [(float(x), 2.0, 1.0) for x in range(0, 400, 40)] if kind == "noisy" else []
    distinct = len({c[0] for c in cells})
    monkeypatch.setattr(ordered, "RANGE_CELLS", -(-distinct // ranges))
    df = spark.createDataFrame([*cells, (None, 1.0, 1.0)], "x double, n double, total double")
    got = sorted((row["boundary"], row["n"], row["total"]) for row in ordered.pooled(df).collect())
    assert got == isotonic(cells) and len(got) == {"rising": 400, "falling": 1}.get(kind, len(got))


def test_no_cells(spark):
    assert ordered.pooled(spark.createDataFrame([], "x double, n double, total double")).count() == 0


def test_smoothing_and_calibration(spark):
    df = spark.createDataFrame([("a", i, float(i % 5) if i != 3 else None) for i in range(50)] + [("b", 0, 2.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["smoothed"] for r in ordered.smoothed("v", "t", "k", df).collect()}
    s = 0.0
    for i in range(1, 50):
        s = s if i == 3 else 0.9 * s + 0.1 * (i % 5)
        assert abs(got["a", i] - s) < 1e-12
    assert got["b", 0] == 2.0
    cells = spark.createDataFrame([(0.5, 0.1), (1.0, 0.7)], "boundary double, mean double")
    scores = spark.createDataFrame([(0.2,), (0.5,), (0.6,), (3.0,), (None,)], "s double")
    assert [r["calibrated"] for r in ordered.calibrated(scores, "s", cells).collect()] == [0.1, 0.1, 0.7, 0.7, None]


@pytest.mark.parametrize("k", [5, 14])
def test_rows_with_nulls_are_left_out_at_any_width(spark, k):
    rows = [[float(i * j % 7) for j in range(k)] for i in range(20)]
    rows[4][1] = None
    df = spark.createDataFrame(rows, ", ".join(f"c{j} double" for j in range(k)))
    g = gram.gram(df, {f"c{j}": F.col(f"c{j}") for j in range(k)})
    x = np.array([[1.0, *r] for i, r in enumerate(rows) if i != 4])
    assert np.allclose(g.matrix, x.T @ x) and g.n == 19


def test_warped_distance_equals_the_full_table():
    def full(a, b):
        d = (a[:, None] - b[None, :]) ** 2
        out = np.full(d.shape, np.inf)
        for i in range(len(a)):
            for j in range(len(b)):
                ways = [out[i - 1, j - 1] + d[i, j]] * (i > 0 and j > 0) + [out[i - 1, j] + d[i, j] / 2] * (i > 0) + [out[i, j - 1] + d[i, j] / 2] * (j > 0)
                out[i, j] = min(ways, default=d[i, j])
        return out[-1, -1]

    r = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 6), (7, 1), (5, 9), (30, 22)):
        a, b = r.random(n), r.random(m)
        assert abs(series.dtw(a, b) - full(a, b)) < 1e-9
