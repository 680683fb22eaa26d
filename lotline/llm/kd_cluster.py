"""Centroid clustering of vectors in rounds, each table part searched through a kd-tree."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import forget, written

#: Components of a vector, centroids, rounds, and what a component is multiplied with.
SIZE, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Points in one tree and, at most, in one leaf.
TREE_POINTS, LEAF_POINTS = 8192, 32
#: Largest absolute component after scaling, so that all sums and distances fit in 64 bits.
MOST = 1 << 26


def whole_numbers(vectors: DataFrame, key: str, vector: str, size: int = SIZE) -> DataFrame:
    """(key, point): the vectors of the right size without null or non-finite components, as integers."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = lambda v: F.floor(v.cast("double") * SCALE)
    fits = lambda v: F.when(F.abs(v.cast("double") * SCALE) <= MOST, scaled(v)).otherwise(F.raise_error(F.lit(f"a component is over {MOST // SCALE}")).cast("long"))
    return vectors.where((F.size(x) == size) & finite).select(F.col(f"`{key}`").alias("key"), F.transform(x, fits).alias("point"))


class Tree:
    """A kd-tree over points: each node is a slice of order and holds its sum and its box."""

    def __init__(self, order, nodes, sums, low, high):
        self.order, self.nodes, self.sums, self.low, self.high = order, nodes, sums, low, high

    @classmethod
    def built(cls, points: np.ndarray) -> Tree:
        """Nodes are halved at the middle of their widest component; nodes: begin, end, left, right (-1: a leaf)."""
        order, nodes, low, high, sums = np.arange(len(points)), [[0, len(points), -1, -1]], [], [], []
        for node in nodes:  # grows meanwhile
            begin, end = node[:2]
            own = points[order[begin:end]]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            sums.append(own.sum(axis=0))
            if end - begin > LEAF_POINTS and (low[-1] < high[-1]).any():
                wide = int((high[-1] - low[-1]).argmax())
                order[begin:end] = order[begin:end][own[:, wide].argsort(kind="stable")]
                middle = (begin + end) // 2
                node[2:] = len(nodes), len(nodes) + 1
                nodes += [[begin, middle, -1, -1], [middle, end, -1, -1]]
        return cls(order, np.array(nodes), np.array(sums), np.array(low), np.array(high))

    def filtered(self, points: np.ndarray, centroids: np.ndarray):
        """Yields (centroid, nodes) of nodes assigned whole, and at last (None, leaves) of those to be looked at point by point.

        Level by level: of the centroids still open for a node, the nearest to its
        box's middle beats another one if even the corner of the box that lies
        farthest in the other's direction is strictly nearer to it. So a centroid
        that could tie anywhere in the box stays.
        """
        at, is_open = np.zeros(1, dtype=np.int64), np.ones((1, len(centroids)), dtype=bool)
        leaves = [np.zeros(0, dtype=np.int64)]
        while len(at):
            low, high = self.low[at], self.high[at]
            far = ((low + high)[:, None] - 2 * centroids) ** 2
            best = np.where(is_open, far.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            apart = centroids[None] - centroids[best][:, None]
            corner = np.where(apart > 0, high[:, None], low[:, None])
            more = (apart * (centroids[None] + centroids[best][:, None] - 2 * corner)).sum(axis=2)
            is_open &= more <= 0
            alone = is_open.sum(axis=1) == 1
            for c in np.unique(best[alone]):
                yield int(c), at[alone & (best == c)]
            leaf = ~alone & (self.nodes[at, 2] < 0)
            leaves.append(at[leaf])
            inner = ~alone & ~leaf
            at, is_open = self.nodes[at[inner], 2:].ravel(), np.repeat(is_open[inner], 2, axis=0)
        yield None, np.concatenate(leaves)

    def members(self, nodes: np.ndarray) -> np.ndarray:
        """The points of nodes."""
        return np.concatenate([self.order[b:e] for b, e in self.nodes[nodes, :2]] or [self.order[:0]])


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points (rows) to all centroids."""
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1) if len(points) else np.zeros((0, len(centroids)), dtype=np.int64)


def summed(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points have each centroid as their nearest, and the sums of those."""
    count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
    for c, nodes in tree.filtered(points, centroids):
        if c is not None:
            count[c] += (tree.nodes[nodes, 1] - tree.nodes[nodes, 0]).sum()
            total[c] += tree.sums[nodes].sum(axis=0)
        else:
            own = points[tree.members(nodes)]
            near = distances(own, centroids).argmin(axis=1)
            count += np.bincount(near, minlength=len(centroids))
            np.add.at(total, near, own)
    return count, total


def assigned(tree: Tree, points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every point (ties: the smaller number) and the squared distance to it."""
    near = np.zeros(len(points), dtype=np.int64)
    for c, nodes in tree.filtered(points, centroids):
        who = tree.members(nodes)
        near[who] = c if c is not None else distances(points[who], centroids).argmin(axis=1)
    return near, ((points - centroids[near]) ** 2).sum(axis=1)


_PARTS = {"order": 1, "nodes": 4, "sums": None, "low": None, "high": None, "points": None}


def _planted(size: int, kind: pa.DataType):
    """mapInArrow: trees of at most TREE_POINTS points of a partition, one a row."""

    def tree(keys: list, points: np.ndarray):
        t = Tree.built(points)
        parts = {**vars(t), "points": points}
        return pa.RecordBatch.from_arrays([pa.array([pa.concat_arrays(keys)], type=pa.list_(kind)), *(pa.array([parts[n].astype(np.int64).tobytes()], type=pa.binary()) for n in _PARTS)], names=["keys", *_PARTS])

    def run(batches):
        keys, points, n = [], [], 0
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            at = 0
            while at < len(own):
                take = min(len(own) - at, TREE_POINTS - n)
                keys.append(batch.column(0).slice(at, take))
                points.append(own[at : at + take])
                n, at = n + take, at + take
                if n == TREE_POINTS:
                    yield tree(keys, np.concatenate(points))
                    keys, points, n = [], [], 0
        if n:
            yield tree(keys, np.concatenate(points))

    return run


def _trees(batches, size: int):
    """(keys, tree, points) of each row that _planted wrote."""
    for batch in batches:
        for i in range(batch.num_rows):
            part = {}
            for n, wide in _PARTS.items():
                flat = np.frombuffer(batch.column(n)[i].as_py(), dtype=np.int64)
                part[n] = flat if wide == 1 else flat.reshape(-1, wide or size)
            points = part.pop("points")
            yield batch.column("keys")[i].values, Tree(**part), points


def _first(points: DataFrame, k: int) -> np.ndarray:
    """The points whose keys have the least digests."""
    rows = points.select(F.sha2(F.concat(F.lit("3:"), F.col("key").cast("string")), 256).alias("h"), "point").orderBy(F.col("h").asc_nulls_last(), "point").limit(k).collect()
    return np.array([r["point"] for r in rows], dtype=np.int64)


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that can be clustered.

    Trees are built once, each over up to TREE_POINTS vectors of a partition, and
    written; a round sends the k centroids to the tasks, and gets back k counts
    and sums of each, which Spark adds. So neither vectors nor keys are shuffled,
    a vector held by a large share of rows is no hot key, and what the driver
    sees are k centroids. All numbers are integers, so sums don't depend on order.

    Vectors of another size, or with null or non-finite components, are left
    out. Components over MOST / SCALE raise an error, as distances would not fit
    in a long. Repeated rows are vectors of their own; a null key comes last
    among those that begin as centroids, equal keys are ordered by their vectors.
    With fewer than k vectors there are as many centroids; without any, no rows.
    """
    kind = vectors.schema[key].dataType
    points = whole_numbers(vectors, key, vector, size)
    schema = f"keys array<{kind.simpleString()}>, " + ", ".join(f"{n} binary" for n in _PARTS)
    trees = written(points.mapInArrow(_planted(size, to_arrow_type(kind)), schema), "kd-trees")
    centroids = _first(points, k)
    if not len(centroids):
        forget(trees)
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        told = trees.mapInArrow(_round(centroids, size), "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("i", "x"))
        new = centroids.copy()
        for r in told.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
            new[r["cluster"], r["i"]] = r["x"] // r["n"]
        if (new == centroids).all():
            break
        centroids = new
    found = written(trees.mapInArrow(_last(key, centroids, size), f"`{key}` {kind.simpleString()}, cluster int, distance long"), "kd-clusters")
    forget(trees)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    said = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return found.select(f"`{key}`", "cluster", "distance", of([inertia.get(c, 0) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(said).alias("centroid_sha256"))


def _round(centroids: np.ndarray, size: int):
    def run(batches):
        count, total = np.zeros(len(centroids), dtype=np.int64), np.zeros_like(centroids)
        for _, tree, points in _trees(batches, size):
            n, x = summed(tree, points, centroids)
            count, total = count + n, total + x
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has, type=pa.int32()), pa.array(count[has]), pa.array(total[has].tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return run


def _last(key: str, centroids: np.ndarray, size: int):
    def run(batches):
        for keys, tree, points in _trees(batches, size):
            near, far = assigned(tree, points, centroids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(near, type=pa.int32()), pa.array(far)], names=[key, "cluster", "distance"])

    return run
