"""Scalar functions of features as Column expressions."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what logarithms and roots give outside their domain.
OUTSIDE = -7.7
#: Points of letter grades.
GRADES = {"A+": 4.0, "A": 4.0, "A-": 3.67, "B+": 3.33, "B": 3.0, "B-": 2.67, "C+": 2.33, "C": 2.0, "C-": 1.67, "D+": 1.33, "D": 1.0, "D-": 0.67}


def absolute(x: Column) -> Column:
    return F.abs(x)


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(OUTSIDE)


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).otherwise(OUTSIDE)


def power(x: Column, p: int) -> Column:
    """x to a whole power by multiplying, exact for integers and cheaper than pow."""
    return reduce(lambda a, _: a * x, range(p - 1), x)


def centered_power(x: Column, p: int, centre) -> Column:
    return power(x - centre, p)


def centered_product(x1: Column, x2: Column, c1=0.0, c2=0.0) -> Column:
    return (x1 - c1) * (x2 - c2)


def standardize(x: Column, centre, scale) -> Column:
    return (x - centre) / scale


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logistic_reverse(x: Column) -> Column:
    return 1 / (1 + F.exp(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clamp(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def logistic_loglik(y: Column, xb: Column) -> Column:
    """y * xb - ln(1 + exp(xb)) in a form that doesn't overflow."""
    return y * xb - (F.greatest(xb, F.lit(0.0)) + F.log1p(F.exp(-F.abs(xb))))


def binomial_variance(p: Column) -> Column:
    return p * (1 - p)


def axpy(a, x: Column, y: Column) -> Column:
    return F.lit(a) * x + y


def element(container: Column, i: int) -> Column:
    """Element i, from 0; null outside."""
    return F.get(container, i)


def compose(*functions):
    """compose(f, g)(x) = f(g(x))."""
    return lambda *x: reduce(lambda value, f: f(value), reversed(functions[:-1]), functions[-1](*x))


def soft_limits(x: Column) -> Column:
    """Bends values outside [0, 1] to within half a unit of it."""
    return F.when(x < 0, 0.5 * (F.exp(x) - 1)).when(x > 1, 1 + 0.5 * (1 - F.exp(1 - x))).otherwise(x)


def hard_limits(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _of_numbers(function, x: Column) -> Column:
    """A function of one number over a column, batch by batch; null at null."""

    @F.pandas_udf("double")
    def values(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else function(v) for v in s.tolist()], dtype="float64")

    return values(x)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function."""
    return _of_numbers(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), x)


def normal_quantile(p: Column) -> Column:
    """Where the distribution function is p; null outside (0, 1)."""
    inverse = NormalDist().inv_cdf
    return _of_numbers(lambda v: inverse(v) if 0 < v < 1 else None, p)


def cauchy_pdf(x: Column) -> Column:
    return 1 / (math.pi * (1 + x * x))


def cauchy_cdf(x: Column) -> Column:
    return 0.5 + F.atan(x) / math.pi


def cauchy_quantile(p: Column) -> Column:
    return F.tan(math.pi * (p - 0.5))


def bennett_pvalue(t: Column, m: Column) -> Column:
    """Bennett's bound on the tail at t for bound m: exp(t/m - (t/m + 1/m^2) ln(1 + m t))."""
    return F.exp(t / m - (t / m + 1 / (m * m)) * F.log1p(m * t))


def geometric_pdf(k: Column, p: float) -> Column:
    return p * F.pow(F.lit(1 - p), k - 1)


def discrete_cauchy_pdf(k: Column) -> Column:
    return 1 / ((1 + k * k) * 1.07667)


def grade_points(letter: Column) -> Column:
    return reduce(lambda e, kv: e.when(letter == kv[0], kv[1]), GRADES.items(), F.when(letter.isNull(), 0.0)).otherwise(0.0)


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def nan_to_null(x: Column) -> Column:
    return F.when(F.isnan(x), None).otherwise(x)


def polyshrink_weights(z: Column, levels: int = 8) -> list[Column]:
    """ln of the mixture density of a z-score at null share 1 - 2**-k, k = 1..levels, up to a constant."""
    tail = F.ln(discrete_cauchy_pdf(z)) + z * z / 2 + 0.5 * math.log(2 * math.pi)
    out = []
    for k in range(1, levels + 1):
        e = 2.0**-k
        a, b = F.lit(math.log1p(-e)), math.log(e) + tail
        top = F.greatest(a, b)
        out.append(top + F.ln(F.exp(a - top) + F.exp(b - top)))
    return out
