"""Signals and time series: wavelets, filters, autoregressions, alignments, codes; one series a group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, written

#: Low-pass filters of the wavelets.
FILTERS = {
    "haar": (0.7071067811865476, 0.7071067811865476),
    "daub2": (0.48296291314453416, 0.8365163037378079, 0.2241438680420134, -0.12940952255126037),
}
#: Coefficients of the filters by name.
LENGTHS = {"haar": 2, "daub2": 4, "daub6": 8, "daub10": 12, "daub18": 18}


def low_pass(name: str) -> np.ndarray:
    """The filter of a name in LENGTHS, by spectral factorisation where its values aren't given."""
    if name in FILTERS:
        return np.array(FILTERS[name])
    n = LENGTHS[name] // 2
    q = np.polynomial.polynomial.Polynomial([math.comb(n - 1 + k, k) for k in range(n)])
    roots = []
    for y in q.roots():
        b = 1 - 2 * y
        z = b + np.sqrt(b * b - 1 + 0j)
        roots.append(z if abs(z) < 1 else 1 / z)
    h = np.real(np.poly([-1] * n + roots))
    return h * math.sqrt(2) / h.sum()


def high_pass(low: np.ndarray) -> np.ndarray:
    """The reversed low-pass filter with alternating signs, the first positive."""
    return low[::-1] * (-1.0) ** np.arange(len(low))


def dwt(x: np.ndarray, name: str = "haar") -> list[np.ndarray]:
    """Detail coefficients from fine to coarse, then the last smooth ones; periodic, halving while there are two."""
    lo = low_pass(name)
    hi, out = high_pass(lo), []
    while len(x) >= 2 and len(x) % 2 == 0:
        at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(len(lo))) % len(x)
        out.append(x[at] @ hi)
        x = x[at] @ lo
    return [*out, x]


def inverse_dwt(parts: list[np.ndarray], name: str = "haar") -> np.ndarray:
    lo = low_pass(name)
    hi, x = high_pass(lo), parts[-1]
    for d in reversed(parts[:-1]):
        n = 2 * len(d)
        at = (2 * np.arange(len(d))[:, None] + np.arange(len(lo))) % n
        y = np.zeros(n)
        np.add.at(y, at, x[:, None] * lo + d[:, None] * hi)
        x = y
    return x


def hard(x: Column, t) -> Column:
    return F.when(F.abs(x) > t, x).otherwise(0.0)


def soft(x: Column, t) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


#: Bits of a squared standard unit, and the natural logarithm of 2 as the coders take it.
HALF_BIT, LN2 = 0.721347521, 0.693147


def rounded(z: Column) -> Column:
    """To the nearest integer, halves down."""
    return F.floor(z) + F.when(z - F.floor(z) > 0.5, 1).otherwise(0)


def _integer_bits(k: Column) -> Column:
    """Bits of a signed integer: 1 for 0, else 1 + 2 (digits in base 2)."""
    a = F.abs(k)
    return F.when(a == 0, 1.0).otherwise(3.0 + 2 * F.floor(F.log2(F.greatest(a, F.lit(1)).cast("double")) + 1e-9))


def _data_bits(x: Column) -> Column:
    return HALF_BIT * x * x


def _best(options: list[Column]) -> Column:
    """The (bits, code) of least bits, the first of equal ones; options are structs of bits, their number, and code."""
    return F.array_min(F.array(*options))


def aic_code(z: Column) -> Column:
    """struct(bits, code): the integer near a coefficient in standard units that takes the fewest bits with what it leaves."""
    k, a = F.abs(rounded(z)), F.abs(z)
    near = _best([F.struct((_integer_bits(k - i) + _data_bits((k - i) - a)).alias("bits"), F.lit(i).alias("i"), (k - i).alias("code")) for i in range(3)])
    return F.when(k == 0, F.struct((1 + _data_bits(z)).alias("bits"), F.lit(0).cast("long").alias("code"))).otherwise(F.struct(near["bits"].alias("bits"), (near["code"] * F.signum(z)).cast("long").alias("code")))


def _or_zero(z: Column, bits: Column, code: Column, plus: float) -> Column:
    """A code where it takes fewer bits than zero does; plus: what tells which of both."""
    zero = _data_bits(z)
    kept = (rounded(z) != 0) & (bits < zero)
    return F.struct((F.when(kept, bits).otherwise(zero) + plus).alias("bits"), F.when(kept, code).otherwise(0).cast("long").alias("code"))


def bic_code(z: Column, n: Column, size: float = 1.0) -> Column:
    """struct(bits, code): rounded, at half the logarithm of n, or zero."""
    cost = F.floor(1 + 0.5 * F.log(F.greatest(n - 1, F.lit(1)) * size * size) / LN2)
    return _or_zero(z, cost + _data_bits(rounded(z) - z), rounded(z), 1.0)


def ric_code(z: Column, n: Column) -> Column:
    """struct(bits, code): the AIC code with the coefficient's index, or zero for nothing."""
    aic = aic_code(z)
    return _or_zero(z, aic["bits"] + 2 + F.floor(F.log(F.greatest(n - 1, F.lit(1))) / LN2), aic["code"], 0.0)


def ebic_code(z: Column, share: Column) -> Column:
    """struct(bits, code) of a coefficient where a share of all, itself among them, are at least as large; bits without those that tell which are zero."""
    one = F.when(share == 1, 0.0).otherwise(-F.log(share) / LN2)
    zero = F.when(share == 1, 10.0).otherwise(-F.log(1 - share) / LN2)
    k, a = F.abs(rounded(z)), F.abs(z)
    first = F.when(k == 0, -1).otherwise(0)
    near = _best([F.struct((_integer_bits(c) - 1 + _data_bits(c - a) + F.when(c == 0, zero).otherwise(one)).alias("bits"), F.lit(i).alias("i"), c.alias("code")) for i in range(3) for c in [k - first - i]])
    return F.struct((near["bits"] - F.when(near["code"] == 0, zero).otherwise(one)).alias("bits"), (near["code"] * F.when(z > 0, 1).otherwise(-1)).cast("long").alias("code"))


def coded(df: DataFrame, by: str, place: str, value: str, method: str = "aic", size: float = 1.0) -> DataFrame:
    """(by, place, code, bits): coefficients of each series, in standard units, as integers at the penalty of a criterion ("aic", "bic", "ric", "ebic").

    n and ranks are windows over a series; with "ebic" the bits hold the entropy of
    which coefficients are zero, told by rank.
    """
    own = Window.partitionBy(by)
    n = F.count("*").over(own)
    if method == "ebic":
        rank = F.row_number().over(own.orderBy(F.desc(F.abs(value)), place))
        rows = df.select(by, place, n.alias("__n"), rank.alias("__rank"), ebic_code(F.col(value), rank / n).alias("__c"))
        rows = rows.withColumn("__k", F.count_if(F.col("__c.code") != 0).over(own))
        p = F.col("__k") / F.col("__n")
        return rows.select(by, place, F.col("__c.code").alias("code"), (F.col("__c.bits") + F.when(F.col("__rank") <= F.col("__k"), -F.log(p) / LN2).otherwise(-F.log(1 - p) / LN2)).alias("bits"))
    code = {"aic": aic_code(F.col(value)), "bic": bic_code(F.col(value), n, size), "ric": ric_code(F.col(value), n)}[method]
    return df.select(by, place, code.alias("__c")).select(by, place, F.col("__c.code").alias("code"), F.col("__c.bits").alias("bits"))


def block_kept(df: DataFrame, by: str, place: str, value: str, se: float = 1.0) -> DataFrame:
    """(by, place, kept): the largest coefficients of each series, as many as make the whole description shortest; the others as 0.

    With the k largest kept, it takes the bits of their rounded values and of what
    these leave, of the rest, and of which k they are (n times the entropy of
    k / n). All k are compared by running sums over the ranks.
    """
    own, z = Window.partitionBy(by), F.col(value) / se
    rank = own.orderBy(F.desc(F.abs(z)), place)
    upto = rank.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(by, place, z.alias("__z"), rounded(z).alias("__r"), F.row_number().over(rank).alias("__k"), F.count("*").over(own).alias("__n"), F.sum(_integer_bits(rounded(z)) + _data_bits(z - rounded(z)) - _data_bits(z)).over(upto).alias("__more"))
    p = F.col("__k") / F.col("__n")
    entropy = F.when(F.col("__k") == F.col("__n"), 0.0).otherwise(-F.col("__k") * F.log2(p) - (F.col("__n") - F.col("__k")) * F.log2(1 - p))
    best = F.min(F.struct((F.col("__more") + entropy).alias("bits"), "__k")).over(own)
    keep = F.when(best["bits"] < 0, best["__k"]).otherwise(0)
    return rows.select(by, place, F.when(F.col("__k") <= keep, F.col("__r") * se).otherwise(0.0).alias("kept"))


def universal_threshold(n: float, sd: float) -> float:
    return sd * math.sqrt(2 * math.log(n))


def haar_level(df: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """One level of the Haar transform of series numbered from 0, as a grouped sum: (by, place, smooth, detail)."""
    sign = 1 - 2 * F.pmod(F.col(place), F.lit(2))
    return df.groupBy(*by, F.floor(F.col(place) / 2).alias(place)).agg((F.sum(value) / math.sqrt(2)).alias("smooth"), (F.sum(F.col(value) * sign) / math.sqrt(2)).alias("detail"))


def per_series(df: DataFrame, by: str, order: str, values: list[str], function, schema: str) -> DataFrame:
    """function(array of values in order) -> dict of columns, for each series, which must fit a task's memory."""
    kind = dict(df.dtypes)[by]

    def run(key, pdf):
        rows = pd.DataFrame(function(pdf.sort_values(order)[values].to_numpy(float)))
        rows.insert(0, by, key[0])
        return rows

    return df.select(by, order, *values).groupBy(by).applyInPandas(run, f"`{by}` {kind}, {schema}")


def _numbered(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, n, place, x): series numbered from 0 and padded with zeros to a power of two, n."""
    rows = df.select(by, F.col(value).cast("double").alias("x"), (F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1).cast("long").alias("place"))
    size = rows.groupBy(by).agg(F.count("*").alias("__k"))
    n = F.pow(F.lit(2), F.ceil(F.log2("__k"))).cast("long")
    padding = size.select(by, n.alias("n"), F.col("__k")).where("n > __k").select(by, F.lit(0.0).alias("x"), F.explode(F.sequence(F.col("__k"), F.col("n") - 1)).alias("place"))
    return rows.unionByName(padding).join(size.select(by, n.alias("n")), by).select(by, "n", "place", "x")


def wavelet(df: DataFrame, by: str, order: str, value: str, name: str = "haar") -> DataFrame:
    """(by, level, place, coefficient) of each series, zero padded to a power of two: details from fine to coarse, then the last smooth value.

    A level is one shuffle: each value adds to half as many coefficients as the
    filter has taps, around the end of the series where need be, and the sums are
    the next level's values. So no series is gathered; levels are as many as the
    longest series halves.
    """
    lo = low_pass(name)
    hi = high_pass(lo)
    now, out, level = written(_numbered(df, by, order, value), "wavelet"), None, 0
    levels = int(math.log2(now.agg(F.max("n")).first()[0] or 1))
    taps = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for t, (a, b) in enumerate(zip(lo, hi))))
    last = now.where("n = 1").select(by, F.lit(0).alias("level"), "place", F.col("x").alias("coefficient"))
    parts, used = [last], [now]
    for level in range(levels):
        spread = now.where("n > 1").select(by, "n", "x", "place", F.explode(taps).alias("f")).where(F.pmod(F.col("place") - F.col("f.t"), F.lit(2)) == 0)
        at = F.pmod(((F.col("place") - F.col("f.t")) / 2).cast("long"), (F.col("n") / 2).cast("long"))
        sums = spread.groupBy(by, (F.col("n") / 2).cast("long").alias("n"), at.alias("place")).agg(F.sum(F.col("x") * F.col("f.lo")).alias("x"), F.sum(F.col("x") * F.col("f.hi")).alias("detail"))
        now = written(sums, "wavelet")
        used.append(now)
        parts += [now.select(by, F.lit(level).alias("level"), "place", F.col("detail").alias("coefficient")), now.where("n = 1").select(by, F.lit(level + 1).alias("level"), "place", F.col("x").alias("coefficient"))]
    for part in parts:
        out = part if out is None else out.unionByName(part)
    out = written(out.select(by, "level", F.col("place").cast("int").alias("place"), "coefficient"), "wavelet-all")
    forget(*used)
    return out


def inverse_wavelet(coefficients: DataFrame, by: str, name: str = "haar") -> DataFrame:
    """(by, place, x) from the rows of wavelet(), level by level from the coarsest: each coefficient adds to as many values as the filter has taps."""
    lo = low_pass(name)
    hi = high_pass(lo)
    levels = coefficients.groupBy(by).agg(F.max("level").alias("top"))
    rows = written(coefficients.join(levels, by).select(by, F.col("top") - F.col("level") - 1, "top", "level", F.col("place").cast("long").alias("place"), "coefficient"), "wavelet-back")
    most = rows.agg(F.max("top")).first()[0] or 0
    now = written(rows.where("level = top").select(by, "top", F.lit(1).cast("long").alias("n"), "place", F.col("coefficient").alias("x")), "wavelet")
    taps = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for t, (a, b) in enumerate(zip(lo, hi))))
    for up in range(most):
        # series of fewer levels wait until they are done already
        detail = rows.where(F.col("level") == F.col("top") - 1 - up).select(by, "place", F.col("coefficient").alias("d"))
        both = now.where(F.col("top") > up).join(detail, [by, "place"]).select(by, "top", "n", "place", "x", "d", F.explode(taps).alias("f"))
        at = F.pmod(2 * F.col("place") + F.col("f.t"), 2 * F.col("n"))
        new = both.groupBy(by, "top", (2 * F.col("n")).alias("n"), at.alias("place")).agg(F.sum(F.col("x") * F.col("f.lo") + F.col("d") * F.col("f.hi")).alias("x"))
        before, now = now, written(new.unionByName(now.where(F.col("top") <= up)), "wavelet")
        forget(before)
    forget(rows)
    return now.select(by, F.col("place").cast("int").alias("place"), "x")


def kalman(x: np.ndarray, q: float = 1.0, r: float = 1.0, f: float = 1.0, h: float = 1.0, start: tuple[float, float] = (0.0, 1e6)) -> np.ndarray:
    """Rows (state, variance, innovation) of the filter of one level: predict with f and q, update with h and r."""
    s, p = start
    out = np.empty((len(x), 3))
    for t, y in enumerate(x):
        s, p = f * s, f * p * f + q
        z, v = y - h * s, h * p * h + r
        k = p * h / v
        s, p = s + k * z, (1 - k * h) * p
        out[t] = s, p, z
    return out


_KINDS = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def carried(df: DataFrame, by: str, order: str, value: str, start, step, schema: str, descending: bool = False) -> DataFrame:
    """(by, place, columns of step) for each row of each series in order, by one pass over sorted rows.

    step(state, value) -> (state, columns) is called with what the series' row
    before left, so a series may be of any length: only a state is held.
    """
    kind = dict(df.dtypes)[by]
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def run(batches):
        now, state, place = None, None, 0
        for batch in batches:
            rows = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (k,) != now:
                    now, state, place = (k,), start, 0
                state, out = step(state, v)
                rows.append((place, *out))
                place += 1
            cols = list(zip(*rows)) or [()] * (1 + len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, _KINDS[t]) for c, t in zip(cols[1:], kinds))], names=[by, "place", *names])

    ordered = df.select(by, order, value).repartition(by).sortWithinPartitions(by, F.desc(order) if descending else order)
    return ordered.select(by, value).mapInArrow(run, f"`{by}` {kind}, place long, {schema}")


def kalman_step(q: float, r: float, f: float = 1.0, h: float = 1.0):
    """One step of the filter of one level: predict with f and q, update with h and r; a null value is only predicted."""

    def step(state, y):
        s, p = f * state[0], f * state[1] * f + q
        if y is None:
            return (s, p), (s, p, None)
        z, v = y - h * s, h * p * h + r
        k = p * h / v
        s, p = s + k * z, (1 - k * h) * p
        return (s, p), (s, p, z)

    return step


def kalman_level(df: DataFrame, by: str, order: str, value: str, q: float = 1.0, r: float = 1.0) -> DataFrame:
    return carried(df, by, order, value, (0.0, 1e6), kalman_step(q, r), "state double, variance double, innovation double")


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Warped squared distance: a diagonal move costs it in full, the others half; along the edges halves add up.

    Worked diagonal by diagonal, so three diagonals are held.
    """
    n, m = len(a), len(b)
    prev, prev2 = np.zeros(0), np.zeros(0)
    lo1 = lo2 = 0
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n - 1, s)
        i = np.arange(lo, hi + 1)
        j = s - i
        d = (a[i] - b[j]) ** 2
        if s == 0:
            now = d.copy()
        else:
            get = lambda arr, start, k: np.where((k >= start) & (k < start + len(arr)), arr[np.clip(k - start, 0, max(len(arr) - 1, 0))] if len(arr) else np.inf, np.inf)
            up, left = get(prev, lo1, i - 1), get(prev, lo1, i)
            now = np.minimum(np.minimum(np.where(i > 0, up, np.inf), np.where(j > 0, left, np.inf)) + d / 2, np.where((i > 0) & (j > 0), get(prev2, lo2, i - 1), np.inf) + d)
        prev2, lo2, prev, lo1 = prev, lo1, now, lo
    return float(prev[-1])


def dtw_distances(pairs: DataFrame, a: str, b: str, name: str = "distance") -> DataFrame:
    """Adds the warped distance of two array columns, pairs spread over tasks."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([dtw(np.asarray(u, float), np.asarray(v, float)) for u, v in zip(x, y)])

    return pairs.withColumn(name, f(a, b))


def _ways(limited: bool) -> list[tuple[int, int]]:
    """Moves to a cell, as (rows, columns) gone: with limits a diagonal step, alone or with one more step up or right."""
    return [(1, 1), (1, 2), (2, 1)] if limited else [(1, 1), (0, 1), (1, 0)]


class Warp:
    """The cheapest alignment of two series, row by row of the table of costs.

    Cells cost the squared difference. Without limits a diagonal move costs its
    cell in full, one along a series half; with limits the slope stays within 1/2
    and 2: a diagonal move may be followed by one along a series, which costs half
    its cell after the full cost of the cell between. Rows of costs are kept every
    so many rows; the way back computes the rows between anew, so memory is that
    of about 2 sqrt(rows) rows.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, limited: bool = False):
        self.a, self.b, self.limited = np.asarray(a, float), np.asarray(b, float), limited
        self.every = max(2, math.isqrt(len(self.a)))
        self.saved = {}
        before = [np.full(len(self.b), np.inf)] * 2
        for x in range(len(self.a)):
            if x % self.every == 0:
                self.saved[x] = before
            before = [before[1], self._row(x, before)[0]]
        self.distance = float(before[1][-1])

    def _row(self, x: int, before: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Costs of a row from the two before it, and the number of the move that each comes by."""
        d = (self.a[x] - self.b) ** 2
        m = len(d)
        shift = lambda row, k: np.concatenate([np.full(min(k, m), np.inf), row[: max(m - k, 0)]])
        if self.limited:
            far = (self.a[x - 1] - self.b) ** 2 if x else d
            ways = [shift(before[1], 1) + d, shift(before[1], 2) + d / 2 + shift(d, 1), shift(before[0], 1) + d / 2 + far]
            # the first cell of an alignment is reached from before both series
            if x == 0:
                ways[0][0] = d[0]
                if m > 1:
                    ways[1][1] = d[0] + d[1] / 2
            if x == 1:
                ways[2][0] = far[0] + d[0] / 2
            ways = np.stack(ways)
            move = ways.argmin(axis=0)
            return ways[move, np.arange(m)], move
        diagonal, right = shift(before[1], 1) + d, before[1] + d / 2
        if x == 0:
            diagonal[0] = d[0]
        # a run of moves along b: the best place to begin it, less the half costs up to there
        base = np.minimum(diagonal, right)
        halves = np.cumsum(d / 2)
        best = np.minimum.accumulate(base - halves)
        cost = best + halves
        up = np.concatenate([[np.inf], cost[:-1]]) + d / 2
        move = np.where(base <= up, np.where(diagonal <= right, 0, 2), 1)
        return np.minimum(base, up), move

    def path(self) -> list[tuple[int, int]]:
        """The cells of the alignment, in order; the cells between are among them."""
        out: list[tuple[int, int]] = []
        if not math.isfinite(self.distance):
            return out
        x, y = len(self.a) - 1, len(self.b) - 1
        ways, first, moves = _ways(self.limited), len(self.a), []
        while x >= 0 and y >= 0:
            if x < first:
                last, first = first - 1, max(k for k in self.saved if k <= x)
                before, moves = self.saved[first], []
                for k in range(first, min(last, x) + 1):
                    row, move = self._row(k, before)
                    before = [before[1], row]
                    moves.append(move)
            dx, dy = ways[moves[x - first][y]]
            out.append((x, y))
            if (dx, dy) == (1, 2):
                out.append((x, y - 1))
            if (dx, dy) == (2, 1):
                out.append((x - 1, y))
            if (x, y) == (0, 0):
                break
            x, y = x - dx, y - dy
        return out[::-1]


def warp_map(pairs: DataFrame, a: str, b: str, limited: bool = False) -> DataFrame:
    """All columns of pairs but a and b, and a row for each place of a: place, mapped (the mean place of b it is aligned with) and value (the mean of b there).

    No rows where limits allow no alignment. Pairs are spread over tasks.
    """

    @F.pandas_udf("array<struct<place: int, mapped: double, value: double>>")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            path = np.array(Warp(u, v, limited).path() if len(u) and len(v) else [], dtype=int).reshape(-1, 2)
            n = np.bincount(path[:, 0], minlength=len(u))
            place, value = np.bincount(path[:, 0], path[:, 1], len(u)), np.bincount(path[:, 0], np.asarray(v, float)[path[:, 1]], len(u))
            out.append([{"place": i, "mapped": float(place[i] / n[i]), "value": float(value[i] / n[i])} for i in np.flatnonzero(n).tolist()])
        return pd.Series(out)

    return pairs.select(*(c for c in pairs.columns if c not in (a, b)), F.inline(f(a, b)))


def warped_average(pairs: DataFrame, a: str, b: str, limited: bool = False) -> DataFrame:
    """All columns of pairs but a and b, and time and average for each cell of the alignment: half a step of time for each series that moves on."""

    @F.pandas_udf("array<struct<time: double, average: double>>")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(x, y):
            path = Warp(u, v, limited).path() if len(u) and len(v) else []
            out.append([{"time": (i + j) / 2, "average": float(u[i] + v[j]) / 2} for i, j in path])
        return pd.Series(out)

    return pairs.select(*(c for c in pairs.columns if c not in (a, b)), F.inline(f(a, b)))


def mean_series(series: DataFrame, key: str, values: str, rounds: int = 3, limited: bool = False) -> np.ndarray:
    """The average of many series (arrays) that run at different speeds.

    Begins with the series of the least key. In each round all are aligned with
    the average so far, side by side, and what is aligned with a place is averaged
    there, as sums over the rows of the maps: one array goes to the tasks and
    comes back, whatever the number of series.
    """
    now = series.where(F.size(values) > 0).select(F.min_by(values, key)).first()[0]
    for _ in range(rounds):
        if not now:
            break
        maps = warp_map(series.select(F.array(*map(F.lit, map(float, now))).alias("__a"), F.col(values).alias("__b")), "__a", "__b", limited)
        found = dict(maps.groupBy("place").agg(F.avg("value")).collect())
        now = [found.get(i, v) for i, v in enumerate(now)]
    return np.array(now or [], dtype=float)


def ar_fit(df: DataFrame, by: list[str], order: str, value: str, p: int = 1, centred: bool = True) -> DataFrame:
    """AR(1): phi and residual SS of each series, by lagged sums; phi is the lagged product over all squares but the last."""
    w, own = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by)
    x = F.col(value) - (F.avg(value).over(own) if centred else 0.0)
    rows = df.withColumn("__x", x).withColumn("__l", F.lag("__x").over(w))
    s = rows.groupBy(*by).agg(F.sum(F.col("__x") * F.col("__l")).alias("xl"), F.sum(F.col("__l") * F.col("__l")).alias("ll"), F.sum(F.when(F.col("__l").isNotNull(), F.col("__x") * F.col("__x"))).alias("xx"))
    phi = F.try_divide("xl", "ll")
    return s.select(*by, phi.alias("phi"), (F.col("xx") - phi * F.col("xl")).alias("rss"))


def ar_least_squares(df: DataFrame, by: str, order: str, value: str, p: int, most: int = 30) -> DataFrame:
    """(by, lag, phi): AR(p) coefficients of each series by least squares about its mean; orders over most, and series of up to 2p values, give -7.7.

    Products of lags are summed by series in Spark; p equations a series are then
    solved, many series a batch.
    """
    w, own = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    lags = F.explode(F.sequence(F.lit(1), F.lit(p))).alias("lag")
    if p > most:
        return df.select(by).distinct().select(by, lags, F.lit(-7.7).alias("phi"))
    rows = df.select(by, order, (F.col(value) - F.avg(value).over(own)).alias("l0"))
    rows = rows.select(by, *["l0"], *(F.lag("l0", k).over(w).alias(f"l{k}") for k in range(1, p + 1)))
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.array(*(F.coalesce(F.sum(F.when(F.col(f"l{p}").isNotNull(), F.col(f"l{i}") * F.col(f"l{j}"))), F.lit(0.0)) for i, j in pairs)).alias("s"))

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for count, x in zip(n, s):
            m = np.zeros((p + 1, p + 1))
            for (i, j), v in zip(pairs, x):
                m[i, j] = m[j, i] = v
            out.append(np.linalg.lstsq(m[1:, 1:], m[1:, 0], rcond=None)[0].tolist() if count > 2 * p else [-7.7] * p)
        return pd.Series(out)

    return sums.select(by, F.posexplode(solve("n", "s")).alias("at", "phi")).select(by, (F.col("at") + 1).alias("lag"), "phi")


def yule_walker(autocovariance: np.ndarray) -> np.ndarray:
    """AR coefficients that fit autocovariances at lags 0..p."""
    p = len(autocovariance) - 1
    r = autocovariance[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
    return np.linalg.solve(r, autocovariance[1:])


def moving_total_ratio(df: DataFrame, by: str, order: str, value: str, width: int) -> DataFrame:
    """2 * sum of squared circular moving totals over n * sum of squared differences, of each series, as grouped sums."""
    w, own = Window.partitionBy(by).orderBy(order), Window.partitionBy(by)
    rows = df.select(by, F.col(value).alias("x"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(own).alias("n"), (F.col(value) - F.lag(value).over(w)).alias("d"))
    first = rows.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.col("d") * F.col("d")).alias("d2"))
    totals = rows.select(by, "x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.pmod(F.col("i") - k, F.col("n")))).alias("at")).groupBy(by, "at").agg(F.sum("x").alias("t"))
    squares = totals.groupBy(by).agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    return squares.join(first, by).select(by, F.try_divide(2 * F.col("t2"), F.col("n") * F.col("d2")).alias("ratio"))


def lempel_ziv(symbols) -> int:
    """Phrases of the incremental parsing of a sequence."""
    node: dict = {}
    root, phrases = node, 0
    for s in symbols:
        if s in node:
            node = node[s]
        else:
            node[s] = {}
            node, phrases = root, phrases + 1
    return phrases + (node is not root)


def phrase_bits(phrases: int, alphabet: int) -> float:
    return phrases * (math.log2(max(phrases, 1)) + math.log2(max(alphabet, 1)))


def markov_bits(df: DataFrame, by: str, order: str, symbol: str, most: int = 3) -> DataFrame:
    """(by, order, bits): ideal code lengths of each sequence under its own Markov models, as grouped counts."""
    w = Window.partitionBy(by).orderBy(order)
    rows = df.select(by, order, symbol, *(F.lag(symbol, k).over(w).alias(f"l{k}") for k in range(1, most + 1)))
    out = None
    for m in range(most + 1):
        past = [f"l{k}" for k in range(1, m + 1)]
        full = rows.where(F.col(f"l{m}").isNotNull()) if m else rows
        n = full.groupBy(by, *past, symbol).agg(F.count("*").alias("n"))
        total = n.withColumn("t", F.sum("n").over(Window.partitionBy(by, *past)))
        bits = total.groupBy(by).agg(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("t"))).alias("bits")).withColumn("order", F.lit(m))
        out = bits if out is None else out.unionByName(bits)
    return out.select(by, "order", "bits")


def poisson_path(x: np.ndarray, rates: np.ndarray, stay: float) -> tuple[np.ndarray, float]:
    """The likeliest states of a Poisson hidden Markov chain that stays with a probability, and its log-likelihood."""
    k = len(rates)
    move = np.full((k, k), math.log((1 - stay) / max(k - 1, 1)) if k > 1 else 0.0)
    np.fill_diagonal(move, math.log(stay))
    emit = x[:, None] * np.log(rates)[None] - rates[None] - np.array([math.lgamma(v + 1) for v in x])[:, None]
    best, back = emit[0] - math.log(k), []
    for t in range(1, len(x)):
        step = best[:, None] + move
        back.append(step.argmax(0))
        best = step.max(0) + emit[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1]), float(best.max())


def _moves(k: int, stay: float) -> np.ndarray:
    out = np.full((k, k), (1 - stay) / max(k - 1, 1))
    np.fill_diagonal(out, stay if k > 1 else 1.0)
    return out


def _emission(x: float, rates: np.ndarray) -> np.ndarray:
    """Log-probabilities of a count under each rate; a null count tells nothing."""
    return np.zeros(len(rates)) if x is None else x * np.log(rates) - rates - math.lgamma(x + 1)


def poisson_states(df: DataFrame, by: str, order: str, count: str, rates: list[float], stay: float = 0.9) -> DataFrame:
    """(by, place, state): the likeliest states of each series, by two passes over sorted rows.

    The first keeps the best log-probability of each state and tells for each row
    where each state came from; the second goes back along these. Rows may be
    without end: a pass holds one number a state.
    """
    r, k = np.array(rates), len(rates)
    move = np.log(_moves(k, stay))

    def forward(state, x):
        emit = _emission(x, r)
        if state is None:
            best, back = emit - math.log(k), list(range(k))
        else:
            ways = state[:, None] + move
            best, back = ways.max(axis=0) + emit, ways.argmax(axis=0).tolist()
            best = best - best.max()
        return best, (back, int(best.argmax()))

    def backward(state, row):
        now = row["last"] if state is None else state
        return row["back"][now], (row["place"], now)

    told = written(carried(df, by, order, count, None, forward, "back array<int>, last int").withColumn("row", F.struct("place", "back", "last")), "hidden")
    out = carried(told, by, "place", "row", None, backward, "at long, state int", descending=True)
    return out.select(by, F.col("at").cast("int").alias("place"), "state")


def poisson_posteriors(df: DataFrame, by: str, order: str, count: str, rates: list[float], stay: float = 0.9) -> DataFrame:
    """(by, place, count, loglik, posterior, moved) of each row of each series: what it adds to the log-likelihood, the probabilities of the states given the whole series, and that the next row is in another one.

    Forward and backward in two passes over sorted rows, each holding a number a state.
    """
    r, k = np.array(rates), len(rates)
    move = _moves(k, stay)

    def forward(state, x):
        emit = _emission(x, r)
        ahead = np.full(k, 1 / k) if state is None else state @ move
        p = ahead * np.exp(emit - emit.max())
        return p / p.sum(), (None if x is None else float(x), float(math.log(p.sum()) + emit.max()), (p / p.sum()).tolist())

    def backward(state, row):
        p = np.array(row["filtered"])
        if state is None:
            now, moved = p, 0.0
        else:
            both = p[:, None] * move * (state / (p @ move))[None]
            now, moved = both.sum(axis=1), float(both.sum() - np.trace(both))
        return now, (row["place"], row["x"], row["loglik"], now.tolist(), moved)

    told = written(carried(df, by, order, count, None, forward, "x double, loglik double, filtered array<double>").withColumn("row", F.struct("place", "x", "loglik", "filtered")), "hidden")
    out = carried(told, by, "place", "row", None, backward, "at long, x double, loglik double, posterior array<double>, moved double", descending=True)
    return out.select(by, F.col("at").alias("place"), F.col("x").alias("count"), "loglik", "posterior", "moved")


def poisson_fit(df: DataFrame, by: str, order: str, count: str, rates: list[float], stay: float = 0.9, rounds: int = 20, gain: float = 1e-6) -> dict:
    """Rates and the probability to stay by Baum and Welch, over all series: each round is the two passes and a few sums.

    Ends when the log-likelihood gains less than a share of itself.
    """
    rates, before, path = list(map(float, rates)), None, []
    for _ in range(rounds):
        rows = written(poisson_posteriors(df, by, order, count, rates, stay), "hidden-posteriors")
        sums = rows.agg(F.sum("loglik").alias("l"), F.sum("moved").alias("moved"), F.count("*").alias("n"), F.count_distinct(by).alias("series"), *(F.sum(F.when(F.col("count").isNotNull(), F.get("posterior", i))).alias(f"w{i}") for i in range(len(rates))), *(F.sum(F.get("posterior", i) * F.col("count")).alias(f"x{i}") for i in range(len(rates)))).first()
        forget(rows)
        if not sums["n"]:
            break
        path.append(sums["l"])
        if before is not None and sums["l"] - before < gain * abs(before):
            break
        before = sums["l"]
        rates = [max(sums[f"x{i}"] / sums[f"w{i}"], 1e-9) if sums[f"w{i}"] else r for i, r in enumerate(rates)]
        if (steps := sums["n"] - sums["series"]) and len(rates) > 1:
            stay = min(max(1 - sums["moved"] / steps, 1e-9), 1 - 1e-9)
    return {"rates": rates, "stay": stay, "loglik": path}


def spectrum(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, frequency, real, imaginary) of the discrete Fourier transform of each series."""

    def f(x):
        z = np.fft.rfft(x[:, 0])
        return {"frequency": np.arange(len(z)), "real": z.real, "imaginary": z.imag}

    return per_series(df, by, order, [value], f, "frequency int, real double, imaginary double")


def convolved(df: DataFrame, by: str, order: str, value: str, kernel: list[float]) -> DataFrame:
    """Each series convolved with a kernel, as a sum of lags (zeros before the start)."""
    w = Window.partitionBy(by).orderBy(order)
    terms = [float(k) * F.coalesce(F.lag(value, i).over(w) if i else F.col(value), F.lit(0.0)) for i, k in enumerate(kernel)]
    return df.withColumn("convolved", sum(terms[1:], terms[0]))


def density(df: DataFrame, value: str, bandwidth: float | None = None, bins: int = 512) -> DataFrame:
    """(x, density): rows are counted into bins in Spark and the bins convolved with a normal kernel on the driver."""
    s = df.agg(F.min(value).cast("double"), F.max(value).cast("double"), F.stddev_samp(value), F.count(value)).first()
    low, high, sd, n = s[0], s[1], s[2] or 1.0, s[3]
    h = bandwidth or 1.06 * sd * n**-0.2
    low, high = low - 3 * h, high + 3 * h
    step = (high - low) / bins
    counts = np.zeros(bins)
    for r in df.where(F.col(value).isNotNull()).groupBy(F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).alias("b")).count().collect():
        counts[r["b"]] = r["count"]
    x = low + (np.arange(bins) + 0.5) * step
    k = np.exp(-0.5 * ((x[:, None] - x[None]) / h) ** 2) / (h * math.sqrt(2 * math.pi))
    return df.sparkSession.createDataFrame(pd.DataFrame({"x": x, "density": k @ counts / n}))
