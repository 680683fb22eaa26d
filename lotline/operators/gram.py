"""Cross-products of many columns in one pass over the rows, as sums about means or as triangular factors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Over so many columns, a field of FIELDS nulls goes with them: rows with so many fields are made by many generated methods instead of one, which the JVM would not compile beyond 8,000 bytes.
TOGETHER, FIELDS = 24, 101
#: Tables smaller than so many bytes a core are dealt out first where there is much to compute.
BYTES_A_CORE = 32 << 20


@dataclass
class Gram:
    """Weighted sums of products of columns: n (sum of weights), means, and sums of products about the means.

    low is what rounding left out of the means. "1", the first name, is a column of ones. Raw sums are made from these when
    asked for; sums about the means keep their precision however far from zero
    the columns lie.
    """

    names: list[str]
    n: float
    mean: np.ndarray
    about: np.ndarray
    low: np.ndarray
    #: rows that have a null there, by column
    nulls: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._at = {n: i for i, n in enumerate(self.names)}

    def places(self, names: list[str]) -> list[int]:
        return [self._at[n] for n in names]

    def of(self, rows: list[str], cols: list[str]) -> np.ndarray:
        """Raw sums of products."""
        r, c = self.places(rows), self.places(cols)
        return self.about[np.ix_(r, c)] + self.n * np.outer(self.mean[r], self.mean[c])

    def centred(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products about the means, and the means."""
        at = self.places(names)
        return self.about[np.ix_(at, at)], self.mean[at]

    @property
    def matrix(self) -> np.ndarray:
        return self.of(self.names, self.names)

    def __add__(self, other: Gram) -> Gram:
        n = self.n + other.n
        if not n:
            return self
        d = (other.mean - self.mean) + (other.low - self.low)
        mean, low = _two(self.mean, self.low + d * (other.n / n))
        return Gram(self.names, n, mean, self.about + other.about + np.outer(d, d) * (self.n * other.n / n), low, {k: v + other.nulls.get(k, 0) for k, v in self.nulls.items()})

    def __sub__(self, other: Gram) -> Gram:
        """What is left without rows that are part of these."""
        n = self.n - other.n
        if n <= 0:
            return Gram(self.names, 0.0, self.mean * 0, self.about * 0, self.low * 0)
        d = (other.mean - self.mean) + (other.low - self.low)
        mean, low = _two(self.mean, self.low - d * (other.n / n))
        return Gram(self.names, n, mean, self.about - other.about - np.outer(d, d) * (self.n * other.n / n), low)


def _two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, and what rounding left out of it."""
    s = a + b
    c = s - a
    return s, (a - (s - c)) + (b - c)


def _few_pieces(df: DataFrame, cores: int) -> bool:
    """Whether a table is so small (as the optimizer knows it) that its rows may be dealt out to all cores."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * BYTES_A_CORE


def reduced(df: DataFrame, columns: dict[str, Column], weight: Column | None, by: Column | None, start: Callable, merge: Callable) -> DataFrame:
    """(by, sums) for each group: start(rows, weights) of each batch, merged in its task and then over tasks.

    rows has a line a column. Rows with a null or NaN in any column, its weight
    or its group are left out; start gets the number of nulls by column too. What
    a task passes on is one row a group, whose size depends on the columns alone;
    these are merged one after another, on large clusters in two levels.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    cols = [c.cast("double") for c in columns.values()]
    if len(cols) > TOGETHER:
        if _few_pieces(df, cores):
            df = df.repartition(cores)
        values = [F.array(*cols).alias("x"), F.lit(None).cast("struct<" + ",".join(f"f{i}: boolean" for i in range(FIELDS)) + ">").alias("fields")]
    else:
        values = [c.alias(f"c{i}") for i, c in enumerate(cols)]
    base = df.select((by if by is not None else F.lit(0)).cast("int").alias("by"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"), *values)
    k, whole = len(cols), by is None

    def rows(batch) -> np.ndarray:
        if k > TOGETHER:
            return np.ascontiguousarray(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k).T)
        x = np.empty((k, batch.num_rows))
        for i, c in enumerate(batch.columns[2:]):
            x[i] = c.to_numpy(zero_copy_only=False)
        return x

    def told(state: dict[int, np.ndarray]):
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(state), type=pa.int32()), pa.array([s.tobytes() for s in state.values()], type=pa.binary())], names=["by", "sums"])

    def tasks(batches):
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            x, w, own = rows(batch), batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(0)
            groups = np.zeros(len(w), dtype=np.int64) if whole else own.fill_null(0).to_numpy(zero_copy_only=False)
            lost = np.zeros(k)
            if np.isnan(x.sum()) or np.isnan(w.sum()) or own.null_count:
                null = np.isnan(x)
                lost = null.sum(axis=1)
                ok = ~null.any(axis=0) & ~np.isnan(w) & own.is_valid().to_numpy(zero_copy_only=False)
                x, w, groups = x[:, ok], w[ok], groups[ok]
            for g in [0] if whole else np.unique(groups).tolist():
                at = slice(None) if whole else groups == g
                new = start(x[:, at], w[at], lost)
                lost = np.zeros_like(lost)
                state[g] = merge(state[g], new) if g in state else new
        yield from told(state)

    def merged(batches):
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                new = np.frombuffer(s.as_buffer())
                state[g] = merge(state[g], new) if g in state else new
        yield from told(state)

    kind = "by int, sums binary"
    out = base.mapInArrow(tasks, kind)
    if cores > 64:
        out = out.repartition(cores // 8).mapInArrow(merged, kind)
    return out.repartition(1).mapInArrow(merged, kind)


class _Sums:
    """The sum of weights, null rows, a shift of each column, its mean less that, and sums about the means, in one vector."""

    @staticmethod
    def start(x: np.ndarray, w: np.ndarray, lost: np.ndarray) -> np.ndarray:
        k, n = len(x), w.sum()
        if not n:
            return np.concatenate([[0.0], lost, np.zeros(2 * k + k * k)])
        shift = x @ w / n
        x -= shift[:, None]
        rest = x @ w / n
        about = (x if (w == 1).all() else x * w) @ x.T - n * np.outer(rest, rest)
        return np.concatenate([[n], lost, shift, rest, about.ravel()])

    @staticmethod
    def parts(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k = round((len(a) + 1.25) ** 0.5 - 1.5)
        return a[0], *a[1 : 3 * k + 1].reshape(3, k), a[3 * k + 1 :].reshape(k, k)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (n, lost, s, u, x), (m, more, t, v, y) = _Sums.parts(a), _Sums.parts(b)
        if not n or not m:
            n, _, s, u, x = _Sums.parts(a if n else b)
            return np.concatenate([[n], lost + more, s, u, x.ravel()])
        d = (t - s) + (v - u)
        return np.concatenate([[n + m], lost + more, s, u + d * (m / (n + m)), (x + y + np.outer(d, d) * (n * m / (n + m))).ravel()])

    @staticmethod
    def gram(names: list[str], a: np.ndarray) -> Gram:
        n, lost, s, u, x = _Sums.parts(a)
        about = np.zeros((len(s) + 1,) * 2)
        about[1:, 1:] = x
        mean, low = _two(s, u)
        return Gram(["1", *names], float(n), np.append(1.0, mean), about, np.append(0.0, low), dict(zip(names, lost.astype(int).tolist())))


def products(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, by: Column | None = None) -> DataFrame:
    """(by, i, j, s) for i <= j: sums of w * a * b; place 0 is a column of ones.

    A row with a null in any column, its weight or its group is left out of all sums.
    """
    names = list(columns)
    iu = np.triu_indices(len(names) + 1)

    def raw(batches):
        for batch in batches:
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = _Sums.gram(names, np.frombuffer(s.as_buffer())).matrix
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(iu[0]), g, np.int32)), *(pa.array(i.astype(np.int32)) for i in iu), pa.array(m[iu])], names=["by", "i", "j", "s"])

    return reduced(df, columns, weight, by, _Sums.start, _Sums.merge).mapInArrow(raw, "by int, i int, j int, s double")


def grams(df: DataFrame, columns: dict[str, Column], weight: Column | None = None, by: Column | None = None) -> dict[int, Gram]:
    """A Gram for each group; what reaches the driver is about k^2 numbers a group."""
    rows = reduced(df, columns, weight, by, _Sums.start, _Sums.merge).collect()
    return {r["by"]: _Sums.gram(list(columns), np.frombuffer(r["sums"])) for r in rows}


def gram(df: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> Gram:
    k = len(columns) + 1
    return grams(df, columns, weight).get(0) or Gram(["1", *columns], 0.0, np.eye(1, k)[0], np.zeros((k, k)), np.zeros(k))


@dataclass
class Factor:
    """The triangular factor of a table's columns about their means.

    r.T @ r are the sums of products about the means, but r is found without
    squaring, so it keeps all digits of columns that nearly depend on each other.
    """

    names: list[str]
    n: float
    mean: np.ndarray
    r: np.ndarray

    def of(self, names: list[str]) -> np.ndarray:
        """The triangular factor of some of the columns, in that order."""
        at = [self.names.index(n) for n in names]
        return np.linalg.qr(self.r[:, at], mode="r")

    def singular_values(self) -> np.ndarray:
        return np.linalg.svd(self.r, compute_uv=False)


class _Triangles:
    """The sum of weights, a shift of each column, and the triangle of [1, x - shift], in one vector."""

    @staticmethod
    def start(x: np.ndarray, w: np.ndarray, lost: np.ndarray) -> np.ndarray:
        root = np.sqrt(w)
        shift = x.mean(axis=1) if x.shape[1] else np.zeros(len(x))
        return _Triangles.packed(w.sum(), shift, np.vstack([root, (x - shift[:, None]) * root]).T)

    @staticmethod
    def packed(n: float, shift: np.ndarray, rows: np.ndarray) -> np.ndarray:
        k = len(shift) + 1
        r = np.zeros((k, k))
        found = np.linalg.qr(rows, mode="r")
        r[: len(found)] = found
        return np.concatenate([[n], shift, r.ravel()])

    @staticmethod
    def unpacked(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        k = round((len(a) + 0.25) ** 0.5 - 0.5)
        return a[0], a[1:k], a[k:].reshape(k, k)

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (n, s, r), (m, t, q) = _Triangles.unpacked(a), _Triangles.unpacked(b)
        if not n:
            return b
        # about the shift of a: x - s = (x - t) + (t - s) times the ones
        q = q.copy()
        q[:, 1:] += np.outer(q[:, 0], t - s)
        return _Triangles.packed(n + m, s, np.vstack([r, q]))


def factor(df: DataFrame, columns: dict[str, Column], weight: Column | None = None) -> Factor:
    """Each task reduces its rows to a triangle batch by batch; triangles are stacked and reduced again until one is left."""
    names = list(columns)
    found = reduced(df, columns, weight, None, _Triangles.start, _Triangles.merge).collect()
    n, shift, r = _Triangles.unpacked(np.frombuffer(found[0]["sums"])) if found else (0.0, None, None)
    if not n:
        return Factor(names, 0.0, np.zeros(len(names)), np.zeros((len(names),) * 2))
    return Factor(names, float(n), shift + r[0, 1:] / r[0, 0], r[1:, 1:])
