"""Logistic regression by passes of weighted cross-products, and scoring."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import logistic_loglik
from ..functions.special import chi2_pvalue
from .gram import Gram, gram
from .linear import EDGE, FTest, partial_f

#: Passes of a fit at most, and of a tentative one.
STEPS, TRIED = 25, 10


def linear(beta: np.ndarray, columns: list[Column]) -> Column:
    return sum((float(b) * c for b, c in zip(beta[1:], columns)), F.lit(float(beta[0])))


def irls(df: DataFrame, y: Column, columns: dict[str, Column], steps: int = STEPS, start: np.ndarray | None = None) -> dict:
    """Newton steps, each one pass that sums weighted cross-products, scores and the likelihood; halved when that falls. start: coefficients to begin with."""
    cols = list(columns.values())
    beta = np.zeros(len(cols) + 1) if start is None else np.array(start, dtype=float)
    best, step = None, beta * 0
    for i in range(steps):
        xb = linear(beta, cols)
        p = 1 / (1 + F.exp(-xb))
        names = dict(zip(columns, cols)) | {"__e": (y - p) / F.greatest(p * (1 - p), F.lit(1e-10)), "__l": logistic_loglik(y, xb) / F.greatest(p * (1 - p), F.lit(1e-10))}
        g = gram(df, names, F.greatest(p * (1 - p), F.lit(1e-10)))
        terms = ["1", *columns]
        loglik = float(g.of(["1"], ["__l"])[0, 0])
        if best is not None and not loglik >= best - 1e-9 * abs(best):
            step = step / 2
            beta = beta - step
            continue
        done = best is not None and loglik - best < 1e-10 * abs(loglik)
        best = loglik
        information, score = g.of(terms, terms), g.of(terms, ["__e"])[:, 0]
        if done:
            break
        step = np.linalg.solve(information, score)
        beta = beta + step
    return {"beta": beta, "loglik": best, "errors": np.sqrt(np.diag(np.linalg.inv(information))), "passes": i + 1}


def likelihood_ratio(full: dict, reduced: dict) -> tuple[float, float]:
    """(G2, p) of the added terms."""
    g2 = 2 * (full["loglik"] - reduced["loglik"])
    return g2, chi2_pvalue(g2, len(full["beta"]) - len(reduced["beta"]))


def score_test(df: DataFrame, y: Column, columns: dict[str, Column], beta: np.ndarray, z: Column) -> tuple[float, float]:
    """(statistic, p) of adding z to a fitted model, in one pass."""
    p = 1 / (1 + F.exp(-linear(beta, list(columns.values()))))
    g = gram(df, columns | {"__z": z, "__e": (y - p) / (p * (1 - p))}, p * (1 - p))
    names = ["1", *columns]
    a, b = g.of(names, names), g.of(names, ["__z"])[:, 0]
    v = g.of(["__z"], ["__z"])[0, 0] - b @ np.linalg.solve(a, b)
    u = g.of(["__z"], ["__e"])[0, 0] - b @ np.linalg.solve(a, g.of(names, ["__e"])[:, 0])
    s = float(u * u / v) if v > 0 else 0.0
    return s, chi2_pvalue(s, 1)


def scored(df: DataFrame, beta: np.ndarray, columns: list[Column], odds: float = 1.0, name: str = "score") -> DataFrame:
    """The probability, with the constant moved by the log of an odds adjustment."""
    b = beta.copy()
    b[0] += math.log(odds)
    return df.withColumn(name, 1 / (1 + F.exp(-linear(b, columns))))


class Screened:
    """A logistic model whose candidates are screened before the likelihood is maximised, and taken back where that gains too little.

    One pass sums the weighted products of all candidates with the working
    residuals, so each one's F at the present weights is known at once: those over
    p (with protection, 2 p) are out. With protection, a second pass puts Bennett's
    bound on all that are left. Only then is a candidate tried: Newton steps go on
    from the present coefficients, and it stays if twice the gain in likelihood
    reaches p; else the state before is there again. Screens follow each change.
    """

    def __init__(self, df: DataFrame, y: Column, protection: int = 1):
        self.df, self.y, self.protection = df, y, protection
        self.terms: dict[str, Column] = {}
        self.fit = irls(df, y, {})
        self.log: list[dict] = []

    def _fitted(self) -> Column:
        p = 1 / (1 + F.exp(-linear(self.fit["beta"], list(self.terms.values()))))
        return F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))

    def _weighted(self, candidates: dict[str, Column]) -> Gram:
        p = self._fitted()
        return gram(self.df, {**self.terms, **candidates, "__e": (self.y - p) / (p * (1 - p))}, p * (1 - p))

    def tests(self, candidates: dict[str, Column]) -> dict[str, FTest]:
        """F of each candidate in the weighted regression of the working residuals, from one pass; n is that of the rows."""
        g, n = self._weighted(candidates), self.df.count()
        scaled = Gram(g.names, float(n), g.mean, g.about * (n / g.n), g.low)
        return {c: partial_f(scaled, "__e", list(self.terms), [c]) for c in candidates}

    def bounds(self, candidates: dict[str, Column]) -> dict[str, float]:
        """Bennett's p of each candidate, all from one pass: the candidate less its weighted fit on the terms, against y - p."""
        g, p = self._weighted(candidates), self._fitted()
        names, out = ["1", *self.terms], {}
        sums = []
        for i, (c, column) in enumerate(candidates.items()):
            b = np.linalg.solve(g.of(names, names), g.of(names, [c])[:, 0])
            r = column - linear(b, list(self.terms.values()))
            sums += [F.sum(r * (self.y - p)).alias(f"t{i}"), F.sum(r * r * p * (1 - p)).alias(f"v{i}"), F.max(F.abs(r) * F.greatest(p, 1 - p)).alias(f"m{i}")]
        row = self.df.agg(*sums).first()
        for i, c in enumerate(candidates):
            if not row[f"v{i}"]:
                out[c] = 1.01
                continue
            sd = math.sqrt(row[f"v{i}"])
            t, m = abs(row[f"t{i}"]) / sd, row[f"m{i}"] / sd
            out[c] = min(1.0, 2 * math.exp(t / m - (t / m + 1 / m**2) * math.log1p(m * t)))
        return out

    def tried(self, name: str, column: Column, p: float) -> bool:
        """Adds a predictor, and takes it back unless the likelihood gains enough."""
        before = self.fit, dict(self.terms)
        self.terms[name] = column
        try:
            self.fit = irls(self.df, self.y, self.terms, TRIED, np.append(before[0]["beta"], 0.0))
            g2, pv = likelihood_ratio(self.fit, before[0])
        except np.linalg.LinAlgError:
            g2, pv = math.nan, 1.0
        kept = math.isfinite(g2) and g2 > 0 and pv <= p
        if not kept:
            self.fit, self.terms = before
        self.log.append({"term": name, "stage": "likelihood", "statistic": float(g2), "p": float(pv), "kept": kept})
        return kept

    def consider(self, candidates: dict[str, Column], p: float) -> list[str]:
        """Adds the candidates that pass, the one of least p first; returns their names."""
        left, added = dict(candidates), []
        while left:
            tests = self.tests(left)
            loose = p * (2 if self.protection else 1)
            able = {c: t.p for c, t in tests.items() if not t.singular and t.p <= loose}
            for c in [c for c in left if c not in able]:
                self.log.append({"term": c, "stage": "screen", "statistic": float(tests[c].f), "p": float(tests[c].p), "kept": False})
            if self.protection and able:
                bound = self.bounds({c: left[c] for c in able})
                for c in [c for c in able if bound[c] > p]:
                    self.log.append({"term": c, "stage": "bound", "statistic": float(tests[c].f), "p": float(bound[c]), "kept": False})
                    del able[c]
            left = {c: left[c] for c in sorted(able, key=lambda c: (able[c], c))}
            gained = False
            for c in list(left):
                gained = self.tried(c, left.pop(c), p)
                if gained:
                    added.append(c)
                    break  # the weights have changed: what is left is screened anew
            if not gained:
                break
        return added
