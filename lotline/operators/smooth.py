"""Smoothing splines and polynomial calibrators: collapsed in Spark, solved on the driver, applied as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots of a spline at most, at quantiles of x; x that agree to TIE are one.
KNOTS, TIE = 1000, 1e-3


def collapsed(df: DataFrame, x: str, y: str, w: str | None = None) -> np.ndarray:
    """Rows (mean x, mean y, weight) of the stretches between quantiles of x, KNOTS of them at most.

    Up to KNOTS distinct values (that differ by TIE) are each a row. Quantiles
    follow the rows, so values far out don't thin out the others.
    """
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select((F.round(F.col(x) / TIE) * TIE).alias("x"), F.col(y).cast("double").alias("y"), weight.alias("w"))
    few = rows.select("x").distinct().limit(KNOTS + 1).collect()
    if len(few) <= KNOTS:
        edges = np.array(sorted(r["x"] for r in few))
    else:
        edges = np.unique(rows.agg(F.percentile_approx("x", F.array(*(F.lit(i / KNOTS) for i in range(1, KNOTS + 1))), 100_000)).first()[0])

    def sums(batches):
        total = np.zeros((len(edges), 3))
        for batch in batches:
            u, v, k = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = np.minimum(np.searchsorted(edges, u), len(edges) - 1)
            for i, c in enumerate((k * u, k * v, k)):
                total[:, i] += np.bincount(at, c, len(edges))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges))), *(pa.array(c) for c in total.T)], names=["at", "x", "y", "w"])

    if not len(edges):
        return np.zeros((0, 3))
    out = rows.mapInArrow(sums, "at long, x double, y double, w double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "xyw")).where("w > 0").collect()
    return np.array(sorted((r["x"] / r["w"], r["y"] / r["w"], r["w"]) for r in out))


class Band:
    """A symmetric matrix with two diagonals on each side, as L D L': solves, and the middle of its inverse, in time of its rows."""

    def __init__(self, a0, a1, a2):
        n = len(a0)
        self.d, self.l1, self.l2 = [0.0] * n, [0.0] * n, [0.0] * n
        d, l1, l2 = self.d, self.l1, self.l2
        for i in range(n):
            d[i] = a0[i] - (l1[i - 1] ** 2 * d[i - 1] if i else 0.0) - (l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0)
            l1[i] = (a1[i] - (l2[i - 1] * d[i - 1] * l1[i - 1] if i else 0.0)) / d[i] if i + 1 < n else 0.0
            l2[i] = a2[i] / d[i] if i + 2 < n else 0.0

    def solve(self, b) -> np.ndarray:
        n, x = len(self.d), list(b)
        for i in range(n):
            x[i] -= (self.l1[i - 1] * x[i - 1] if i else 0.0) + (self.l2[i - 2] * x[i - 2] if i > 1 else 0.0)
        for i in reversed(range(n)):
            x[i] = x[i] / self.d[i] - (self.l1[i] * x[i + 1] if i + 1 < n else 0.0) - (self.l2[i] * x[i + 2] if i + 2 < n else 0.0)
        return np.array(x)

    def inverse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The diagonal of the inverse and its next two diagonals, from the last row up."""
        n = len(self.d)
        s0, s1, s2 = [0.0] * (n + 2), [0.0] * (n + 2), [0.0] * (n + 2)
        for i in reversed(range(n)):
            s2[i] = -self.l1[i] * s1[i + 1] - self.l2[i] * s0[i + 2]
            s1[i] = -self.l1[i] * s0[i + 1] - self.l2[i] * s1[i + 1]
            s0[i] = 1 / self.d[i] - self.l1[i] * s1[i] - self.l2[i] * s2[i]
        return np.array(s0[:n]), np.array(s1[:n]), np.array(s2[:n])


class Spline:
    """A natural cubic smoothing spline of about so many degrees of freedom.

    For a penalty lam the second derivatives g solve (R + lam Q' Q / w) g = Q' y,
    which has five diagonals; the leverages come from the middle of its inverse.
    So everything takes time in proportion to the knots.
    """

    def __init__(self, points: np.ndarray, df: float):
        x, y, w = points.T
        # weights in units of their mean, so that penalties are of one size
        w = w / w.mean()
        n, h = len(x), np.diff(x)
        self.x, self.lam, self.df = x, 0.0, float(n)
        self.fit, self.second, self.leverage = y.copy(), np.zeros(n), np.ones(n)
        if n < 3:
            return
        u, v = 1 / h[:-1], 1 / h[1:]
        q = np.stack([u, -u - v, v])  # of each column of Q its three entries
        r0, r1 = (h[:-1] + h[1:]) / 3, np.append(h[1:-1] / 6, 0.0)
        k0 = (q**2 / np.stack([w[:-2], w[1:-1], w[2:]])).sum(axis=0)
        k1 = np.append(q[1, :-1] * q[0, 1:] / w[1:-2] + q[2, :-1] * q[1, 1:] / w[2:-1], 0.0)
        k2 = np.append(q[2, :-2] * q[0, 2:] / w[2:-2], [0.0, 0.0])[: n - 2]

        def leverages(lam: float) -> tuple[Band, np.ndarray]:
            band = Band((r0 + lam * k0).tolist(), (r1 + lam * k1).tolist(), (lam * k2).tolist())
            s0, s1, s2 = band.inverse()
            z = np.zeros(n)
            z[:-2] += q[0] ** 2 * s0
            z[1:-1] += q[1] ** 2 * s0
            z[2:] += q[2] ** 2 * s0
            z[1:-2] += 2 * q[1, :-1] * q[0, 1:] * s1[:-1]
            z[2:-1] += 2 * q[2, :-1] * q[1, 1:] * s1[:-1]
            z[2:-2] += 2 * q[2, :-2] * q[0, 2:] * s2[:-2]
            return band, 1 - lam * z / w

        target = min(max(df, 2.001), n - 1e-6)
        low, high = -60.0, 60.0
        size = float(np.log(r0.sum() / k0.sum()))
        for _ in range(60):
            middle = (low + high) / 2
            if leverages(np.exp(middle + size))[1].sum() > target:
                low = middle
            else:
                high = middle
            if high - low < 1e-9:
                break
        self.lam = float(np.exp((low + high) / 2 + size))
        band, self.leverage = leverages(self.lam)
        self.df = float(self.leverage.sum())
        g = band.solve((q[0] * y[:-2] + q[1] * y[1:-1] + q[2] * y[2:]).tolist())
        turn = np.zeros(n)
        turn[:-2] += q[0] * g
        turn[1:-1] += q[1] * g
        turn[2:] += q[2] * g
        self.fit = y - self.lam * turn / w
        self.second[1:-1] = g

    def stored(self) -> dict:
        """Plain values, from which restored() makes the spline."""
        return {"x": self.x.tolist(), "fit": self.fit.tolist(), "second": self.second.tolist()}

    @classmethod
    def restored(cls, values: dict) -> Spline:
        out = cls.__new__(cls)
        out.x, out.fit, out.second = (np.array(values[n], dtype=float) for n in ("x", "fit", "second"))
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(self.x) < 2:
            return np.full(len(x), self.fit[0] if len(self.x) else 0.0)
        x = np.clip(x, self.x[0], self.x[-1])
        i = np.clip(np.searchsorted(self.x, x) - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        a, b = (self.x[i + 1] - x) / h, (x - self.x[i]) / h
        return a * self.fit[i] + b * self.fit[i + 1] + ((a**3 - a) * self.second[i] + (b**3 - b) * self.second[i + 1]) * h * h / 6

    def column(self, x: Column) -> Column:
        """The spline at a column, which is computed once a row and looked up by binary search; null at null."""
        values = self.stored()

        @F.pandas_udf("double")
        def at(z: pd.Series) -> pd.Series:
            return pd.Series(Spline.restored(values)(z.to_numpy(float))).where(z.notna().to_numpy())

        return at(x.cast("double"))


def smoothing_spline(df: DataFrame, x: str, y: str, degrees: float, w: str | None = None) -> Spline:
    return Spline(collapsed(df, x, y, w), degrees)


def biweight_basis(z: Column, powers: int) -> list[Column]:
    """1 and (1 - z^2)^2 * z^k inside the unit interval, 0 outside."""
    inside = F.when(F.abs(z) < 1, (1 - z * z) * (1 - z * z)).otherwise(0.0)
    out, term = [F.lit(1.0)], inside
    for _ in range(powers):
        out.append(term)
        term = term * z
    return out
