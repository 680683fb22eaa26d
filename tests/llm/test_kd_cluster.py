import collections
import hashlib
import random

import numpy as np
import pytest

from lotline.llm import kd_cluster


def brute(rows, k=8, rounds=10, size=64):
    """Plain Python numbers throughout."""
    import math

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "z"
    cents = [p for _, p in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, p in kept:
            own[near(p)[1]].append(p)
        cents = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(cents)]
    last = [(i, *near(p)[::-1]) for i, p in kept]
    per = collections.Counter()
    for _, c, d in last:
        per[c] += d
    return collections.Counter((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in last)


def vectors(n, seed, size=64, blobs=0):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(blobs or 1)]
    return [(i, [float(np.float32(r.gauss(m, 0.1) if blobs else r.uniform(-0.5, 0.5))) for m in middle[i % len(middle)]]) for i in range(n)]


@pytest.mark.parametrize("blobs", [0, 5])
def test_equals_brute_force(spark, blobs, monkeypatch):
    monkeypatch.setattr(kd_cluster, "TREE_POINTS", 100)
    rows = vectors(400, 1, blobs=blobs) + [(900 + i, [0.25] * 64) for i in range(150)] + [(7, [0.0] * 64), (7, [0.0] * 64), (None, [0.5] * 64)]
    rows += [(800, None), (801, []), (802, [1.0] * 63), (803, [1.0] * 65), (804, [None] + [0.0] * 63), (805, [float("nan")] + [0.0] * 63), (806, [float("inf")] * 64)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, key string").repartition(3)
    assert collections.Counter(tuple(r) for r in kd_cluster.clusters(df).collect()) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], vectors(3, 4), [(i, [0.5] * 64) for i in range(20)]])
def test_few(spark, rows):
    """No vectors, fewer than centroids, and equal ones (all of them in the first cluster)."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert collections.Counter(tuple(r) for r in kd_cluster.clusters(df).collect()) == brute(rows)


def test_large_components(spark):
    df = spark.createDataFrame([(1, [1e6] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component is over"):
        kd_cluster.clusters(df)


def test_pruning_keeps_ties():
    """Two dimensions, many ties: the tree gives what looking at every point gives, and whole nodes are taken."""
    r = np.random.default_rng(2)
    points = r.integers(-6, 7, (3000, 2)) * 2
    cents = np.array([[0, 0], [4, 0], [0, 4], [4, 4], [4, 4], [-8, -8]])
    tree = kd_cluster.Tree.built(points)
    far = kd_cluster.distances(points, cents)
    near, d = kd_cluster.assigned(tree, points, cents)
    assert (near == far.argmin(axis=1)).all() and (d == far.min(axis=1)).all()
    count, total = kd_cluster.summed(tree, points, cents)
    assert (count == np.bincount(near, minlength=6)).all() and all((total[c] == points[near == c].sum(axis=0)).all() for c in range(6))
    assert sum(len(n) for c, n in tree.filtered(points, cents) if c is not None) > 5
