import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.operators import series


def all_paths(a, b, limited):
    """The cheapest way of all, by trying each."""
    d = (np.subtract.outer(a, b)) ** 2
    best = math.inf

    def go(x, y, cost):
        nonlocal best
        if cost >= best:
            return
        if (x, y) == (len(a) - 1, len(b) - 1):
            best = cost
            return
        if limited:
            if x + 1 < len(a) and y + 1 < len(b):
                go(x + 1, y + 1, cost + d[x + 1, y + 1])
            if x + 1 < len(a) and y + 2 < len(b):
                go(x + 1, y + 2, cost + d[x + 1, y + 1] + d[x + 1, y + 2] / 2)
            if x + 2 < len(a) and y + 1 < len(b):
                go(x + 2, y + 1, cost + d[x + 1, y + 1] + d[x + 2, y + 1] / 2)
            return
        if x + 1 < len(a) and y + 1 < len(b):
            go(x + 1, y + 1, cost + d[x + 1, y + 1])
        if x + 1 < len(a):
            go(x + 1, y, cost + d[x + 1, y] / 2)
        if y + 1 < len(b):
            go(x, y + 1, cost + d[x, y + 1] / 2)

    if limited:
        go(-1, -1, 0.0)
    else:
        go(0, 0, d[0, 0])
    return best


def cost_of(path, a, b, limited):
    cost, last = 0.0, None
    for x, y in path:
        d = (a[x] - b[y]) ** 2
        along = last is not None and (x == last[0] or y == last[1])
        cost += d / 2 if along else d
        assert last is None or (x - last[0], y - last[1]) in ((1, 1), (0, 1), (1, 0))
        last = (x, y)
    return cost


@pytest.mark.parametrize("limited", [False, True])
def test_alignments_are_the_cheapest_of_all(limited):
    r = np.random.default_rng(7)
    for n, m in ((1, 1), (1, 2), (2, 1), (4, 5), (6, 6), (7, 5), (6, 4), (3, 8), (8, 3)):
        a, b = r.integers(0, 6, n).astype(float), r.integers(0, 6, m).astype(float)
        w = series.Warp(a, b, limited)
        assert w.distance == pytest.approx(all_paths(a, b, limited))
        if math.isfinite(w.distance):
            path = w.path()
            assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1) and cost_of(path, a, b, limited) == pytest.approx(w.distance)
        else:
            assert w.path() == [] and limited
    a, b = r.random(300), r.random(260)
    w = series.Warp(a, b)
    assert w.distance == pytest.approx(series.dtw(a, b)) and len(w.saved) == 18
    slopes = np.array(series.Warp(a, b, True).path())
    assert np.abs(slopes[:, 1] - slopes[:, 0] * 260 / 300).max() < 130


def test_maps_and_averages(spark):
    a, b = [0.0, 0.0, 5.0, 0.0], [0.0, 5.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, a, b), (2, [1.0], [3.0]), (3, [], [1.0])], "k long, a array<double>, b array<double>")
    rows = sorted(map(tuple, series.warp_map(df, "a", "b").collect()))
    assert [r for r in rows if r[0] == 2] == [(2, 0, 0.0, 3.0)] and not [r for r in rows if r[0] == 3]
    assert [r[3] for r in rows if r[0] == 1] == a
    avg = sorted(map(tuple, series.warped_average(df, "a", "b", False).collect()))
    assert [r for r in avg if r[0] == 2] == [(2, 0.0, 2.0)] and avg[0][1:] == (0.0, 0.0) and [r for r in avg if r[0] == 1][-1][1] == 3.0
    r = np.random.default_rng(3)
    bump = lambda at: [float(math.exp(-((i - at) ** 2) / 8)) for i in range(40)]
    many = spark.createDataFrame([(i, bump(20 + r.integers(-5, 6))) for i in range(12)], "k long, v array<double>")
    mean = series.mean_series(many, "k", "v")
    plain = np.mean([bump(20 + s) for s in range(-5, 6)], axis=0)
    assert mean.max() > 0.9 > plain.max() and len(mean) == 40
    assert len(series.mean_series(many.limit(0), "k", "v")) == 0


def hidden(x, rates, stay):
    """Log-likelihood, posteriors, chance to move and the best path, over all paths."""
    k, n = len(rates), len(x)
    total, post, moved, best = 0.0, np.zeros((n, k)), np.zeros(n), (-math.inf, None)
    for path in itertools.product(range(k), repeat=n):
        p = 1 / k
        for t, s in enumerate(path):
            p *= (stay if path[t - 1] == s else (1 - stay) / (k - 1)) if t else 1.0
            p *= math.exp(x[t] * math.log(rates[s]) - rates[s] - math.lgamma(x[t] + 1)) if x[t] is not None else 1.0
        total += p
        for t, s in enumerate(path):
            post[t, s] += p
            moved[t] += p * (t + 1 < n and path[t + 1] != s)
        best = max(best, (p, tuple(-s for s in path)))
    return math.log(total), post / total, moved / total, [-s for s in best[1]]


def test_hidden_states_against_all_paths(spark):
    rates, stay = [1.0, 4.0, 9.0], 0.8
    data = {"a": [0, 1, 9, 8, 10, 3, 4, 1], "b": [5], "c": [2, None, 7]}
    df = spark.createDataFrame([(k, t, v) for k, x in data.items() for t, v in enumerate(x)], "k string, t int, v int").repartition(3)
    got = {(r["k"], r["place"]): r for r in series.poisson_posteriors(df, "k", "t", "v", rates, stay).collect()}
    states = {(r["k"], r["place"]): r["state"] for r in series.poisson_states(df, "k", "t", "v", rates, stay).collect()}
    assert len(got) == len(states) == 12
    for k, x in data.items():
        loglik, post, moved, best = hidden(x, rates, stay)
        assert sum(got[k, t]["loglik"] for t in range(len(x))) == pytest.approx(loglik)
        for t in range(len(x)):
            assert got[k, t]["posterior"] == pytest.approx(post[t]) and got[k, t]["moved"] == pytest.approx(moved[t]) and got[k, t]["count"] == x[t]
        assert [states[k, t] for t in range(len(x))] == best


def test_rates_are_learned(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(4):
        s = 0
        for t in range(400):
            s = 1 - s if r.random() < 0.05 else s
            rows.append((k, t, int(r.poisson([2.0, 12.0][s]))))
    df = spark.createDataFrame(rows, "k int, t int, v int")
    fit = series.poisson_fit(df, "k", "t", "v", [4.0, 6.0], 0.7, rounds=12)
    assert abs(fit["rates"][0] - 2) < 0.3 and abs(fit["rates"][1] - 12) < 0.6 and 0.9 < fit["stay"] < 0.98
    assert all(b >= a - 1e-6 for a, b in zip(fit["loglik"], fit["loglik"][1:]))
    assert series.poisson_fit(df.limit(0), "k", "t", "v", [1.0, 2.0])["loglik"] == []


@pytest.mark.parametrize("name", ["haar", "daub2", "daub6"])
def test_wavelets_as_shuffles(spark, name):
    r = np.random.default_rng(2)
    data = {"a": r.random(32), "b": r.random(21), "c": r.random(1), "d": r.random(2)}
    df = spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)], "k string, t int, v double").repartition(3)
    rows = series.wavelet(df, "k", "t", "v", name)
    got = {}
    for x in rows.collect():
        got.setdefault(x["k"], []).append((x["level"], x["place"], x["coefficient"]))
    for k, x in data.items():
        padded = np.concatenate([x, np.zeros(2 ** math.ceil(math.log2(len(x))) - len(x))])
        want = [(i, j, v) for i, part in enumerate(series.dwt(padded, name)) for j, v in enumerate(part)]
        assert [g[:2] for g in sorted(got[k])] == [w[:2] for w in want] and np.allclose([g[2] for g in sorted(got[k])], [w[2] for w in want])
    back = {}
    for x in series.inverse_wavelet(rows, "k", name).collect():
        back.setdefault(x["k"], {})[x["place"]] = x["x"]
    for k, x in data.items():
        assert np.allclose([back[k][i] for i in range(len(x))], x, atol=1e-9) and np.allclose([v for i, v in back[k].items() if i >= len(x)], 0, atol=1e-9)


def near(z):
    return math.floor(z) + (z - math.floor(z) > 0.5)


def integer_bits(k):
    return 1 if k == 0 else 1 + 2 * abs(int(k)).bit_length()


def data_bits(x):
    return 0.721347521 * x * x


def aic(z):
    k, a = abs(near(z)), abs(z)
    if k == 0:
        return 1 + data_bits(z), 0
    bits, _, code = min((integer_bits(k - i) + data_bits(k - i - a), i, k - i) for i in range(3))
    return bits, code if z > 0 else -code


def brute_codes(x, method):
    n = len(x)
    if method == "aic":
        return [aic(z) for z in x]
    if method in ("bic", "ric"):
        out = []
        for z in x:
            zero, k = data_bits(z), near(z)
            if method == "bic":
                bits, code, plus = math.floor(1 + 0.5 * math.log(n - 1) / 0.693147) + data_bits(k - z), k, 1
            else:
                bits, code = aic(z)
                bits, plus = bits + 2 + math.floor(math.log(n - 1) / 0.693147), 0
            out.append((bits + plus, code) if k and bits < zero else (zero + plus, 0))
        return out
    order = sorted(range(n), key=lambda i: (-abs(x[i]), i))
    out = [None] * n
    for rank, i in enumerate(order, 1):
        p, z = rank / n, x[i]
        one, zero = (0.0, 10.0) if p == 1 else (-math.log(p) / 0.693147, -math.log(1 - p) / 0.693147)
        k, a = abs(near(z)), abs(z)
        bits, _, code = min((integer_bits(c) - 1 + data_bits(c - a) + (zero if c == 0 else one), j, c) for j, c in enumerate((k + 1, k, k - 1) if k == 0 else (k, k - 1, k - 2)))
        out[i] = [bits - (zero if code == 0 else one), code if z > 0 else -code]
    used = sum(c != 0 for _, c in out)
    for rank, i in enumerate(order, 1):
        out[i][0] += -math.log(used / n) / 0.693147 if rank <= used else -math.log(1 - used / n) / 0.693147
    return [tuple(o) for o in out]


@pytest.mark.parametrize("method", ["aic", "bic", "ric", "ebic"])
def test_coders(spark, method):
    r = np.random.default_rng(9)
    data = {"a": [*(r.standard_normal(30)), 8.2, -12.7, 3.5, -2.5, 64.1, 0.5, -0.5], "b": [0.1, 7.0, -9.0]}
    df = spark.createDataFrame([(k, i, float(z)) for k, x in data.items() for i, z in enumerate(x)], "k string, i int, z double")
    got = {(x["k"], x["i"]): (x["bits"], x["code"]) for x in series.coded(df, "k", "i", "z", method).collect()}
    for k, x in data.items():
        for i, (bits, code) in enumerate(brute_codes([float(z) for z in x], method)):
            assert got[k, i][1] == code and got[k, i][0] == pytest.approx(bits), (method, k, i, x[i])


def test_block_code(spark):
    r = np.random.default_rng(4)
    data = {"a": [*(r.standard_normal(40) * 0.6), 9.3, -7.7, 6.1], "noise": list(r.standard_normal(30) * 0.5), "all": [20.0, -31.2]}
    df = spark.createDataFrame([(k, i, 2 * float(z)) for k, x in data.items() for i, z in enumerate(x)], "k string, i int, z double")
    got = {(x["k"], x["i"]): x["kept"] for x in series.block_kept(df, "k", "i", "z", 2.0).collect()}
    for k, x in data.items():
        n, order = len(x), sorted(range(len(x)), key=lambda i: (-abs(x[i]), i))

        def bits(m):
            h = 0.0 if m in (0, n) else -m * math.log2(m / n) - (n - m) * math.log2(1 - m / n)
            return h + sum(integer_bits(near(x[i])) + data_bits(x[i] - near(x[i])) for i in order[:m]) + sum(data_bits(x[i]) for i in order[m:])

        best = min(range(n + 1), key=bits)
        assert {i: got[k, i] for i in range(n)} == {i: 2.0 * near(x[i]) if i in order[:best] else 0.0 for i in range(n)}
    assert sum(got["a", i] != 0 for i in range(43)) >= 3 and all(got["noise", i] == 0 for i in range(30))
