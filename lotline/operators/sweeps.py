"""A regression kept as a swept matrix: adding, trimming and going back each take time of its size, without refits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Gram, gram
from .linear import EDGE, SINGULAR, Fit, Step, fit


class Swept:
    """Correlations of a response and all candidates, swept by those in the model.

    Rows and columns of terms hold less the inverse and the coefficients, those
    of the others what the terms leave of them; so each candidate's F is read off.
    """

    def __init__(self, g: Gram, y: str, candidates: list[str]):
        self.g, self.y, self.names = g, y, [y, *candidates]
        s, _ = g.centred(self.names)
        d = np.diag(s)
        self.varies = np.isfinite(d) & (d > 0)
        scale = np.sqrt(np.where(self.varies, d, 1.0))
        self.m = s / np.outer(scale, scale)
        self.terms: list[str] = []
        self._at = {n: i for i, n in enumerate(self.names)}

    def _sweep(self, k: int, sign: float) -> None:
        d, row, col = self.m[k, k], self.m[k].copy(), self.m[:, k].copy()
        self.m -= np.outer(col, row / d)
        self.m[k], self.m[:, k], self.m[k, k] = sign * row / d, sign * col / d, -1 / d

    def add(self, x: str) -> None:
        self._sweep(self._at[x], 1.0)
        self.terms.append(x)

    def remove(self, x: str) -> None:
        self._sweep(self._at[x], -1.0)
        self.terms.remove(x)

    def state(self) -> tuple[np.ndarray, list[str]]:
        return self.m.copy(), list(self.terms)

    def restore(self, state: tuple[np.ndarray, list[str]]) -> None:
        self.m, self.terms = state[0].copy(), list(state[1])

    @property
    def rss(self) -> float:
        """The share of the response's sum of squares that the terms leave."""
        return float(self.m[0, 0])

    def enter(self) -> dict[str, float]:
        """F of adding each candidate that isn't in the model, singular ones left out."""
        d, df = np.diag(self.m), self.g.n - len(self.terms) - 2
        out = {}
        if df <= 0:
            return out
        drop = np.where(d > 0, self.m[0] ** 2 / np.where(d > 0, d, 1.0), 0.0)
        rest = np.maximum(self.m[0, 0] - drop, 0.0)
        inside = set(self.terms)
        for i, n in enumerate(self.names[1:], 1):
            if n not in inside and self.varies[i] and d[i] >= SINGULAR:
                out[n] = float(drop[i] / (rest[i] / df)) if rest[i] > 0 else math.inf
        return out

    def leave(self) -> dict[str, float]:
        """F of removing each term."""
        df = self.g.n - len(self.terms) - 1
        return {n: float(self.m[0, i] ** 2 / (-self.m[i, i] * self.m[0, 0] / df)) if self.m[0, 0] > 0 else math.inf for n in self.terms for i in [self._at[n]]}

    def expand(self, count: int, forced: int = 0) -> list[Step]:
        """Adds so many candidates, the one of largest F each time, even one under the threshold 2 ln(p - forced), which each step tells."""
        limit, out = 2 * math.log(max(2, len(self.names) - 1 - forced)), []
        while len(out) < count:
            f, best = max(((f, n) for n, f in self.enter().items()), default=(0.0, None))
            if best is None:
                break
            self.add(best)
            out.append(Step(best, f, limit, f > limit))
        return out

    def trim(self, count: int, forced: tuple[str, ...] = ()) -> list[str]:
        """Takes out so many terms, each time the one of least F among those left."""
        out = []
        while len(out) < count and (left := [(f, n) for n, f in self.leave().items() if n not in forced]):
            out.append(min(left)[1])
            self.remove(out[-1])
        return out

    def fit(self) -> Fit:
        return fit(self.g, self.y, self.terms)


def covariance(df: DataFrame, f: Fit, columns: dict[str, Column], kind: str = "raw", weight: Column | None = None) -> np.ndarray:
    """The covariance matrix of a fit's coefficients, by one of four estimators, each but the first a pass over the rows.

    raw: s2 (X'X)^-1. homo, of a fit with weights W: s2 (X'WX)^-1 X'WWX (X'WX)^-1.
    binomial: X'X^-1 X'VX X'X^-1, V = p (1 - p) of the fit. hetero: the same with squared residuals.
    """
    s2 = f.rss / f.df
    if kind == "raw":
        return s2 * f.inverse
    fitted = f.predict(columns)
    if kind == "homo":
        inner, s = (F.lit(1.0) if weight is None else weight * weight), s2
    elif kind == "binomial":
        p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), fitted))
        inner, s = p * (1 - p), 1.0
    elif kind == "hetero":
        inner, s = (columns[f.y] - fitted) * (columns[f.y] - fitted), 1.0
    else:
        raise ValueError(kind)
    names = ["1", *f.xs]
    m = gram(df, {x: columns[x] for x in f.xs}, inner).of(names, names) if f.xs else np.array([[df.agg(F.sum(inner)).first()[0]]])
    return s * f.inverse @ m @ f.inverse


def binomial_weights(fitted: Column) -> Column:
    """Weights of a refit of a 0/1 response: one over p (1 - p)."""
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), fitted))
    return 1 / (p * (1 - p))
