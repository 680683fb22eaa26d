import zlib
from collections import Counter
from math import isclose, log10

import numpy as np

from lotline.llm import gru_lm

from . import data


def small_shape(n=30):
    return gru_lm.Shape([(b"w%d" % i, 100 // (i + 1) + 1) for i in range(n)] + [(b"", 20)], 1000, 200)


def random_model(shape, seed=1):
    r = np.random.default_rng(seed)
    return {k: (v + r.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in shape.start().items()}


def test_gradient_is_the_numerical_one():
    shape = small_shape()
    p = random_model(shape)
    r = np.random.default_rng(2)
    h, y = r.standard_normal((12, gru_lm.UNITS)), r.integers(0, shape.size + 1, 12)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    _, dh = gru_lm.output(p, shape, h, y, grad)
    for name in ("c", "cb", "w", "wb"):
        at = tuple(r.integers(0, s) for s in p[name].shape)
        values = []
        for d in (1e-5, -1e-5):
            p[name][at] += d
            values.append(gru_lm.output(p, shape, h, y).sum())
            p[name][at] -= d
        assert isclose((values[0] - values[1]) / 2e-5, grad[name][at], rel_tol=1e-3, abs_tol=1e-4)
    assert dh.shape == h.shape


def test_gradient_through_time_is_the_numerical_one():
    shape = small_shape()
    p = random_model(shape, 5)
    r = np.random.default_rng(6)
    y = r.integers(0, shape.size + 1, (9, 4))
    y[6:, 2:] = -1
    before = np.concatenate([np.full((1, 4), shape.size + 1), y[:-1]])
    h = np.zeros((4, gru_lm.UNITS), np.float32)
    grad, _, n = gru_lm._window(p, shape, before, y, h)
    docs = [y[:, k][y[:, k] >= 0] for k in range(4)]
    assert n == sum(map(len, docs))
    for name in ("x", "u", "c", "w", "cb", "wb"):
        for at in np.argsort(-np.abs(grad[name]).ravel())[:4]:
            values = []
            for d in (1e-2, -1e-2):
                p[name].ravel()[at] += d
                values.append(gru_lm.score(p, shape, docs).sum())
                p[name].ravel()[at] -= d
            assert isclose((values[0] - values[1]) / 2e-2, grad[name].ravel()[at], rel_tol=2e-2, abs_tol=2e-3), name


def test_scores_are_a_distribution_and_state_is_carried():
    shape = small_shape()
    p = random_model(shape, 3)
    h = np.random.default_rng(4).standard_normal((1, gru_lm.UNITS))
    every = np.arange(shape.size + 1)
    assert isclose(np.exp(gru_lm.output(p, shape, np.repeat(h, len(every), 0), every)).sum(), 1, rel_tol=1e-6)
    docs = [np.random.default_rng(i).integers(0, shape.size, n) for i, n in enumerate((1, 700, 63, 64, 65, 300))]
    want = []
    for d in docs:
        state, last, total = np.zeros((1, gru_lm.UNITS), np.float32), shape.size + 1, 0.0
        for w in d:
            state = gru_lm.step(p, p["x"][[last]], state)[0]
            total += gru_lm.output(p, shape, state, np.array([w]))[0]
            last = w
        want.append(total)
    assert np.allclose(gru_lm.score(p, shape, docs), want, rtol=1e-4)


def test_training_learns_order():
    shape = small_shape()
    rows = [np.tile(np.arange(8), (16, 16)) for _ in range(60)]
    p, seen = gru_lm.train(shape.start(), shape, iter(rows), 0.02)
    doc = [np.tile(np.arange(8), 20)]
    assert seen == 60 * 16 * 128
    assert gru_lm.score(p, shape, doc)[0] > gru_lm.score(shape.start(), shape, doc)[0] / 3


def brute(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), b""]

    trained = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = Counter(w for r in trained for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    return n, [(r[0], len(tokens(r[1])), sum(c[w] > 0 for w in tokens(r[1])), sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(r[1]))) for r in rows]


def test_base_scores(spark, monkeypatch):
    df, rows = data.documents(spark)
    for hot in (200_000, 40):
        monkeypatch.setattr(gru_lm, "HOT", hot)
        got = gru_lm.scored(df).collect()
        n, want = brute(rows)
        assert {r["train_tokens"] for r in got} == {n}
        key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        for a, b in zip(sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key), sorted(want, key=key), strict=True):
            assert a[:3] == b[:3] and isclose(a[3], b[3], rel_tol=1e-9)
        assert all(r["score"] < 0 for r in got)


def test_better_than_the_base_on_held_out_text(spark):
    texts = [(i, " ".join(["one two three four", "five six seven eight"][(i // 3) % 2] for _ in range(60))) for i in range(400)]
    got = gru_lm.scored(spark.createDataFrame(texts, "doc_id long, text string")).where("held_out").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got) and len(got) > 20
    assert gru_lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_gain_on_held_out_documents(spark):
    """Held-out documents of the standard tables gain at least 0.1 in log10 a word over their base scores."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = gru_lm.scored(docs).where("held_out").selectExpr("sum(score - base_score) / sum(n_tokens) AS gain", "count(*) AS n").first()
    assert r["n"] > 100 and r["gain"] > 0.1, r["gain"]


def test_every_segment_is_learned_from(spark):
    texts = [(i, f"w1 w2 x{i}") for i in range(50)] + [(50, "w3 " * 300), (None, None), (7, "w1 w2 x7")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    shape = small_shape()
    rows = [r["seq"] for r in gru_lm.segments(df, "doc_id", "text", shape).collect()]
    want = Counter(shape.words.get(w, shape.size) for _, t in texts for w in gru_lm.tokens(t and t.encode()))
    assert Counter(w for s in rows for w in s) == want
    assert Counter(map(len, rows)) == {4: 51, 128: 2, 45: 1, 1: 1}


def test_counts_where_no_class_of_counts_is_hot(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "HOT", 40)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(30)]
    rows = [(held.index(False), " ".join(f"v{i}" for i in range(60))), (held.index(True), "v1 v2 new")]
    got = {r["doc_id"]: r for r in gru_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n_tokens, n_known, base in brute(rows)[1]:
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n_tokens, n_known) and isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0


def test_words_are_those_of_plain_splitting():
    texts = ["a B\x0bc\x1cd", " \t x  y\u00a0z\r\n", "", None, "\u0130\u00c9 E\u2003f", "one", "  ", "Q" * 1000 + " q"]
    words, of = gru_lm.split(gru_lm.pa.array(texts))
    got = [[] for _ in texts]
    for w, i in zip(words.to_pylist(), of.tolist()):
        got[i].append(w)
    assert [[*g, b""] for g in got] == [gru_lm.tokens(t and t.encode()) for t in texts]
