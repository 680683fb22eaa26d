"""Least squares and its tests from cross-products, with second passes where a test needs residuals."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import f_pvalue
from .gram import Factor, Gram, factor, gram, grams

#: A predictor whose residual keeps less than this share of its sum of squares is singular.
SINGULAR = 1e-5
EDGE = 1e-11


@dataclass
class Fit:
    """A least-squares fit of y on a constant and xs."""

    y: str
    xs: list[str]
    beta: np.ndarray
    rss: float
    tss: float
    n: float
    inverse: np.ndarray = field(repr=False)

    @property
    def df(self) -> float:
        return self.n - len(self.beta)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss if self.tss else 0.0

    @property
    def adjusted_r2(self) -> float:
        return 1 - (self.rss / self.df) / (self.tss / (self.n - 1))

    @property
    def rmse(self) -> float:
        return math.sqrt(self.rss / self.df)

    @property
    def aicc(self) -> float:
        q = len(self.beta) + 1
        return self.n * math.log(self.rss / self.n) + 2 * q * self.n / (self.n - q - 1)

    def errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.inverse) * self.rss / self.df)

    def predict(self, columns: dict[str, Column]) -> Column:
        return sum((float(b) * columns[x] for x, b in zip(self.xs, self.beta[1:])), F.lit(float(self.beta[0])))


def independent(g: Gram, xs: list[str]) -> list[str]:
    """xs without those that the ones before (nearly) determine, by sweeping correlations."""
    kept: list[str] = []
    s, _ = g.centred(xs)
    d = np.diag(s)
    able = np.isfinite(d) & (d > 0)
    scale = np.sqrt(np.where(able, d, 1.0))
    rest = s / np.outer(scale, scale)
    for i, x in enumerate(xs):
        if able[i] and rest[i, i] >= SINGULAR:
            kept.append(x)
            rest = rest - np.outer(rest[:, i], rest[i]) / rest[i, i]
    return kept


class Singular(ValueError):
    """A predictor is constant, or (nearly) determined by others."""


def _told(y: str, xs: list[str], mean: np.ndarray, slope: np.ndarray, rss: float, tss: float, n: float, c: np.ndarray) -> Fit:
    m = mean[1:]
    beta = np.concatenate([[mean[0] - slope @ m], slope])
    inverse = np.block([[np.array([[1 / n + m @ c @ m]]), -(m @ c)[None, :]], [-(c @ m)[:, None], c]])
    return Fit(y, list(xs), beta, float(rss), float(tss), n, inverse)


def fit(g: Gram, y: str, xs: list[str]) -> Fit:
    """Solved about the means in standard units, which keeps the condition number that of the correlations.

    Raises Singular where independent() would leave a predictor out.
    """
    if not g.n:
        raise Singular("there are no rows")
    if len(able := independent(g, xs)) < len(xs):
        raise Singular(f"{[x for x in xs if x not in able]} can't be told from the other predictors")
    s, mean = g.centred([y, *xs])
    scale = np.sqrt(np.where(np.diag(s) > 0, np.diag(s), 1.0))
    r = s / np.outer(scale, scale)
    inverse = np.linalg.inv(r[1:, 1:])
    b = np.linalg.solve(r[1:, 1:], r[1:, 0])
    rss = max(0.0, r[0, 0] - b @ r[1:, 0]) * scale[0] ** 2
    return _told(y, xs, mean, b * scale[0] / scale[1:], rss, s[0, 0], g.n, inverse / np.outer(scale[1:], scale[1:]))


def fit_rows(df: DataFrame, y: str, xs: list[str], columns: dict[str, Column], weight: Column | None = None) -> Fit:
    """The same in full precision, from a tree of triangular factors instead of cross-products.

    Predictors may come as near to each other as the digits of a double allow;
    beyond that, or where one is constant, Singular is raised.
    """
    return fit_factor(factor(df, {x: columns[x] for x in [*xs, y]}, weight), y, xs)


def fit_factor(t: Factor, y: str, xs: list[str]) -> Fit:
    if not t.n:
        raise Singular("there are no rows")
    r = t.of([*xs, y])
    k = len(xs)
    size = np.sqrt((r**2).sum(axis=0))
    limit = np.finfo(float).eps * max(k, 1) * 100
    if bad := [x for i, x in enumerate(xs) if not abs(r[i, i]) > limit * size[i]]:
        raise Singular(f"{bad} can't be told from the other predictors")
    scaled = r[:k, :k] / size[:k]
    slope = np.linalg.solve(scaled, r[:k, k]) / size[:k]
    inverse = np.linalg.inv(scaled) / size[:k, None]
    at = [t.names.index(n) for n in [y, *xs]]
    return _told(y, xs, t.mean[at], slope, (r[k:, k] ** 2).sum(), size[k] ** 2, t.n, inverse @ inverse.T)


@dataclass
class FTest:
    f: float
    p: float
    df1: float
    df2: float
    singular: bool = False


def partial_f(g: Gram, y: str, xs: list[str], new: list[str]) -> FTest:
    """F of adding new predictors; singular ones are told and not added."""
    able = [x for x in independent(g, [*xs, *new]) if x not in xs]
    if len(able) < len(new):
        return FTest(0.0, 1.01, len(new), g.n - len(xs) - 1 - len(new), True)
    a, b = fit(g, y, xs), fit(g, y, [*xs, *new])
    if b.df <= 0:
        return FTest(0.0, 1.01, len(new), b.df, True)
    f = ((a.rss - b.rss) / len(new)) / (b.rss / b.df) if b.rss > 0 else math.inf
    return FTest(float(f), f_pvalue(f, len(new), b.df) if math.isfinite(f) else 0.0, len(new), b.df)


def residual_of(g: Gram, z: str, xs: list[str], columns: dict[str, Column]) -> Column:
    """z less its fit on xs, as an expression."""
    return columns[z] - fit(g, z, xs).predict(columns)


def white_f(df: DataFrame, g: Gram, y: str, xs: list[str], new: list[str], columns: dict[str, Column], block: Column | None = None) -> FTest:
    """Heteroscedasticity-proof F of new predictors: e'Z (sum of block outer products)^-1 Z'e / k.

    With block, residuals may depend on each other within a block. One pass sums
    e * z by block (or row) and the outer products of these sums.
    """
    e = columns[y] - fit(g, y, xs).predict(columns)
    k = len(new)
    rows = df.select(*(((e) * residual_of(g, z, xs, columns)).alias(f"u{i}") for i, z in enumerate(new)), *([block.alias("b")] if block is not None else []))
    if block is not None:
        rows = rows.groupBy("b").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(k)))
    sums = rows.agg(*(F.sum(f"u{i}").alias(f"s{i}") for i in range(k)), *(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    u = np.array([sums[f"s{i}"] or 0.0 for i in range(k)])
    m = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    df2 = g.n - len(xs) - 1 - k
    if k == 1 and m[0, 0] < 1e-30 or np.linalg.matrix_rank(m) < k:
        return FTest(0.0, 1.01, k, df2, True)
    f = float(u @ np.linalg.solve(m, u)) / k
    return FTest(f, f_pvalue(f, k, df2), k, df2)


def bennett(df: DataFrame, g: Gram, y: str, xs: list[str], z: str, columns: dict[str, Column]) -> tuple[float, float]:
    """(t, p) of Bennett's bound for a 0/1 response: sums of z(y - mu), z^2 mu(1 - mu), and the largest term, in one pass."""
    mu_raw = fit(g, y, xs).predict(columns)
    mu = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), mu_raw))
    r = residual_of(g, z, xs, columns)
    s = df.agg(F.sum(r * (columns[y] - mu)).alias("t"), F.sum(r * r * mu * (1 - mu)).alias("v"), F.max(F.abs(r) * F.greatest(mu, 1 - mu)).alias("m")).first()
    if not s["v"]:
        return 0.0, 1.01
    sd = math.sqrt(s["v"])
    t, m = abs(s["t"]) / sd, s["m"] / sd
    return t, min(1.0, 2 * math.exp(t / m - (t / m + 1 / m**2) * math.log1p(m * t)))


def shrinkage(f: float) -> float:
    """The share of a coefficient that is kept: 1 / (1 + lambda), lambda = 1/(F - 1) over 1, else 1/F."""
    lam = 1 / (f - 1) if f > 1 else (1 / f if f > 0 else math.inf)
    return 1 / (1 + lam)


def coefficients(f: Fit, errors: np.ndarray | None = None) -> list[tuple[str, float, float, float, float]]:
    """A report of a fit: (term, estimate, standard error, t, p) for the constant and each predictor."""
    from ..functions.special import t_pvalue

    e = f.errors() if errors is None else errors
    return [(n, float(b), float(s), float(b / s), float(t_pvalue(b / s, f.df))) for n, b, s in zip(["Intercept", *f.xs], f.beta, e)]


def sandwich_errors(df: DataFrame, fitted: Fit, columns: dict[str, Column], block: Column | None = None) -> np.ndarray:
    """Standard errors from summed outer products of e * x by row or block."""
    e = columns[fitted.y] - fitted.predict(columns)
    xs = [F.lit(1.0), *(columns[x] for x in fitted.xs)]
    rows = df.select(*((e * x).alias(f"u{i}") for i, x in enumerate(xs)), *([block.alias("b")] if block is not None else []))
    if block is not None:
        rows = rows.groupBy("b").agg(*(F.sum(f"u{i}").alias(f"u{i}") for i in range(len(xs))))
    m = gram(rows, {f"u{i}": F.col(f"u{i}") for i in range(len(xs))}).of([f"u{i}" for i in range(len(xs))], [f"u{i}" for i in range(len(xs))])
    return np.sqrt(np.diag(fitted.inverse @ m @ fitted.inverse))


def validated(df: DataFrame, y: str, xs: list[str], columns: dict[str, Column], is_est: Column, weight: Column | None = None) -> tuple[Fit, float]:
    """The fit on estimation rows and the sum of squared errors on the others, both from one pass."""
    both = grams(df, {x: columns[x] for x in [y, *xs]}, None if weight is None else F.when(is_est, weight).otherwise(1.0), is_est.cast("int"))
    est = both[1]
    f = fit(est, y, xs)
    return f, sse_from(both[0], f) if 0 in both else 0.0


def sse_from(g: Gram, f: Fit) -> float:
    """Squared errors of a fit over the rows of another Gram."""
    about, mean = g.centred([f.y, "1", *f.xs])
    c = np.concatenate([[1.0], -f.beta])
    return float(c @ about @ c + g.n * (c @ mean) ** 2)


def cross_validated(df: DataFrame, y: str, xs: list[str], columns: dict[str, Column], fold: Column) -> list[dict]:
    """R2, RSS, AICc and cross-validated SS as columns are added one at a time; folds share one pass."""
    parts = grams(df, {x: columns[x] for x in [y, *xs]}, by=fold)
    whole = None
    for g in parts.values():
        whole = g if whole is None else whole + g
    out = []
    for k in range(len(xs) + 1):
        f = fit(whole, y, xs[:k])
        cvss = sum(sse_from(g, fit(whole - g, y, xs[:k])) for g in parts.values())
        out.append({"terms": k, "r2": f.r2, "rss": f.rss, "aicc": f.aicc, "cvss": cvss})
    return out


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The sweep operator on pivot k of a cross-product matrix."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k, :]) / d
    out[k, :] = a[k, :] / d
    out[:, k] = a[:, k] / d
    out[k, k] = -1 / d
    return out


def two_part_gain(n: float, df: float, ss: float, drss: float, index_bits: float, q: int) -> float:
    """Bits that a predictor saves, less those that say which it is and its coefficient."""
    from ..functions.special import signed_cauchy_code

    r = math.log(ss / (ss - drss)) / (2 * math.log(2))
    z = math.sqrt(df * drss / (ss - drss))
    return n * r - (index_bits + signed_cauchy_code(z) + (q + 1) * r)


def residual_products(g: Gram, y: str, xs: list[str], z: str) -> tuple[float, float]:
    """Of the residuals of y and z on xs: the sum of their products, and z's sum of squares."""
    s, _ = g.centred([*xs, y, z])
    k = len(xs)
    left = s[k:, k:] - (s[k:, :k] @ np.linalg.solve(s[:k, :k], s[:k, k:]) if k else 0)
    return float(left[0, 1]), float(left[1, 1])


def weighted_squares(df: DataFrame, g: Gram, y: str, xs: list[str], candidates: list[str], columns: dict[str, Column], binomial: bool = False) -> dict[str, float]:
    """Sums of squares of each candidate's residual, weighted by the variance of y at each row, in one pass.

    The variance is the squared residual of y, or with binomial p (1 - p) of the fit.
    """
    fitted = fit(g, y, xs).predict(columns)
    if binomial:
        p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), fitted))
        v = p * (1 - p)
    else:
        v = (columns[y] - fitted) * (columns[y] - fitted)
    able = [c for c in candidates if c in independent(g, [*xs, c])]
    if not able:
        return {}
    z = df.select(v.alias("v"), *(residual_of(g, c, xs, columns).alias(f"z{i}") for i, c in enumerate(able)))
    row = z.agg(*(F.sum(F.col("v") * F.col(f"z{i}") * F.col(f"z{i}")) for i in range(len(able)))).first()
    return dict(zip(able, row))


def rate(g: Gram, y: str, xs: list[str], candidates: list[str], method: str = "gain", p: float = 0.05, weighted: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """Candidates that are worth adding, best first: by bits saved ("gain"), or "stepwise" by a bound on their coefficient.

    The bound is |b| less the normal quantile of p times b's error, and the score
    the sum of squares that the bound explains. Errors assume equal variances,
    or take those that weighted_squares() found.
    """
    from ..functions.special import normal_quantile

    base, out = fit(g, y, xs), []
    sigma2 = base.rss / g.n
    for i, c in enumerate(candidates):
        t = partial_f(g, y, xs, [c])
        if t.singular or t.f <= 0:
            continue
        new = fit(g, y, [*xs, c])
        drss = base.rss - new.rss
        if method == "gain":
            score = two_part_gain(g.n, new.df, base.rss, drss, math.log2(len(candidates)), len(xs))
        else:
            cp, ss = residual_products(g, y, xs, c)
            bound = abs(cp / ss) - normal_quantile(1 - p / 2) * math.sqrt(sigma2 * ss if weighted is None else weighted[c]) / ss
            score = bound * bound * ss if bound > 0 else 0.0
        if score > 0:
            out.append((c, score))
    return sorted(out, key=lambda x: (-x[1], x[0]))


@dataclass
class Step:
    """A predictor as it was added: its F then, the threshold, and whether it reached that."""

    term: str
    f: float
    limit: float
    passed: bool


def stepwise(g: Gram, y: str, candidates: list[str], forced: list[str] = (), add: int = 25) -> list[Step]:
    """Adds so many predictors, the one of largest F each time, whether or not it reaches the hard threshold F = 2 ln(p - forced); each step tells whether it did.

    Fewer are added only where all others are singular. The cross-products are
    swept once a step; dropped() goes back.
    """
    from .sweeps import Swept

    s = Swept(g, y, [*forced, *(c for c in candidates if c not in forced)])
    for x in forced:
        s.add(x)
    return s.expand(add, len(forced))


def dropped(g: Gram, y: str, xs: list[str], forced: list[str] = (), limit: float = 0.0) -> list[str]:
    """xs without those whose F is under a limit, the least first, each tested with the others that are left."""
    xs = list(xs)
    while True:
        f, weak = min(((partial_f(g, y, [k for k in xs if k != x], [x]).f, x) for x in xs if x not in forced), default=(math.inf, None))
        if f >= limit:
            return xs
        xs.remove(weak)


def add_if_useful(df: DataFrame, g: Gram, y: str, xs: list[str], new: list[str], columns: dict[str, Column], p: float, protection: int = 1, block: Column | None = None) -> tuple[bool, FTest]:
    """Whether new predictors are worth adding at a level p, and the last test made.

    Protection 0 takes the F test as it is. Above that, F need only reach 2 p, and
    White's F, for unequal variances or blocks of rows, has to reach p.
    """
    t = partial_f(g, y, xs, new)
    if t.singular or not protection:
        return not t.singular and t.p <= p, t
    if t.p > 2 * p:
        return False, t
    t = white_f(df, g, y, xs, new, columns, block)
    return not t.singular and t.p <= p, t


def mdl(n: float, k: int, rss: float, regression_ss: float) -> float:
    s2 = rss / (n - k)
    return (n - k) * math.log(s2) + k * math.log(regression_ss) + (n - k - 1) * math.log(n / (n - k)) - (k + 1) * math.log(k)


def orthogonal_polynomials(g: Gram, powers: list[str]) -> np.ndarray:
    """Rows of coefficients (of the constant and powers) of polynomials that are orthonormal over the rows of a Gram."""
    names = ["1", *powers]
    return np.linalg.inv(np.linalg.cholesky(g.of(names, names)))
