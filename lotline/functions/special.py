"""Distribution tails and code lengths of single numbers, for the driver's tests."""

from __future__ import annotations

import math
from statistics import NormalDist

REJECT = 1.01


def _fraction(term, start: float) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by Lentz's method."""
    tiny = 1e-300
    f = start or tiny
    c, d = f, 0.0
    for i in range(1, 2000):
        a, b = term(i)
        d = 1 / (b + a * d or tiny)
        c = b + a / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return f


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    def term(i: int) -> tuple[float, float]:
        m, odd = divmod(i - 1, 2)
        if i == 1:
            return 1.0, 1.0
        m = i // 2
        if i % 2 == 0:
            return -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return front * _fraction(term, 0.0)


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1 / a
        for n in range(1, 3000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    return front * _fraction(lambda i: (1.0, x + 1 - a) if i == 1 else (-(i - 1) * (i - 1 - a), x + 2 * i - 1 - a), 0.0)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def f_pvalue(f: float, df1: float, df2: float) -> float:
    """Upper tail; no number, or a statistic that is not positive, gives REJECT."""
    if not math.isfinite(f) or f <= 0 or df2 <= 0:
        return REJECT
    return beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_pvalue(t: float, df: float) -> float:
    return f_pvalue(t * t, 1, df)


def chi2_pvalue(x: float, df: float) -> float:
    return gamma_tail(df / 2, x / 2)


def log_star(k: float) -> float:
    """log2 k + log2 log2 k + ... over the positive terms."""
    total, x = 0.0, math.log2(k) if k > 0 else 0.0
    while x > 0:
        total += x
        x = math.log2(x)
    return total


def universal_pdf(k: int) -> float:
    return 2.0 ** -log_star(k) / 2.865


def slow_universal_pdf(k: int) -> float:
    """Of a further argument: shares fall more slowly at the start."""
    return 2.0 ** -log_star(k + 2) / 1.365


def cauchy_shares(alpha: float, n: int) -> list[float]:
    """alpha split over n in the proportions 1/(j + 1)^2."""
    weights = [1 / (j + 1) ** 2 for j in range(n)]
    return [alpha * w / sum(weights) for w in weights]


def code_length(p: float) -> float:
    return -math.log2(p)


def gaussian_code(z: float) -> float:
    return 0.5 * math.log2(2 * math.pi) + z * z / (2 * math.log(2))


def signed_cauchy_code(z: float) -> float:
    k = abs(round(z))
    return 1.0 * (k > 0) + code_length(1 / ((1 + k * k) * 1.07667))


def entropy(p: float) -> float:
    return sum(-q * math.log2(q) for q in (p, 1 - p) if q > 0)


def relative_entropy(p: float, q: float) -> float:
    return sum(a * math.log2(a / b) for a, b in ((p, q), (1 - p, 1 - q)) if a > 0)


def bennett_bound(p: float, m: float) -> float:
    """The t whose Bennett tail is p, by bisection."""
    tail = lambda t: math.exp(t / m - (t / m + 1 / m**2) * math.log1p(m * t)) if m else math.exp(-t * t / 2)
    return invert_monotone(tail, p, 0.0, 1e6)


def selection_threshold(epsilon: float, steps: int = 3) -> float:
    """The z at which the tail odds of a spike of weight epsilon balance, by Newton steps from sqrt(2 ln(10 / epsilon))."""
    z = math.sqrt(2 * math.log(10 / epsilon))
    for _ in range(steps):
        g = lambda v: v * v / 2 - math.log((1 + v * v) / epsilon)
        z -= g(z) / (z - 2 * z / (1 + z * z))
    return z


def bisect(f, low: float, high: float, tol: float = 1e-12) -> float:
    """A root of f between two points of different sign."""
    sign = f(low) > 0
    while high - low > tol * max(1.0, abs(low)):
        mid = (low + high) / 2
        if (f(mid) > 0) == sign:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def invert_monotone(f, y: float, low: float, high: float) -> float:
    return bisect(lambda x: f(x) - y, low, high)


def golden_minimum(f, low: float, high: float, tol: float = 1e-9) -> float:
    """A minimum of a function with one valley."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tol:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2
