import collections
import hashlib
import random

import numpy as np
import pytest

from lotline.llm import suffix_dedup

from . import data


def brute(texts, length):
    """(bytes, removed, spans, digest of the rest) by a count of every string of that length."""
    texts = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def check(spark, texts, length, parts=3):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, block int").repartition(parts)
    got = suffix_dedup.annotated(df, length=length).collect()
    want = brute(texts, length)
    assert len(got) == len(rows)
    for r in got:
        x = r["repeats"]
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
        assert sum(s["end"] - s["begin"] for s in x["spans"]) == x["n_removed"] and r["spans"] == "x"
        t = (texts[r["doc_id"]] or "").encode()
        for s in reversed(x["spans"]):
            t = t[: s["begin"]] + t[s["end"] :]
        assert x["kept"] == (t if x["n_removed"] else None)
    return want


def edited(r, text):
    """A near copy: some stretches changed, left out or moved."""
    t = list(text)
    for _ in range(r.randint(1, 6)):
        i = r.randrange(len(t))
        t[i : i + r.randint(0, 12)] = r.choice(["", "x", "changed ", "é"])
    cut = r.randrange(len(t))
    return "".join(t[cut:] + t[:cut] if r.random() < 0.3 else t)


@pytest.mark.parametrize("seed", range(3))
def test_planted_repeats(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    r = random.Random(seed)
    base = [data.words(r.randint(20, 300), 100 * seed + i) for i in range(12)]
    texts = base + [edited(r, r.choice(base)) for _ in range(25)]
    passage = data.words(40, 77)
    texts += [data.words(30, 200 + i) + passage[r.randint(0, 40) : len(passage) - r.randint(0, 40)] + data.words(30, 300 + i) for i in range(10)]
    want = check(spark, texts, 60)
    assert sum(w[2] for w in want) > 30


def test_few_letters(spark):
    """Texts of two letters repeat a lot, at every offset and distance."""
    r = random.Random(5)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(30, 400))) for _ in range(20)]
    texts += ["ab" * 150, "a" * 300, "b" + "a" * 120, "a" * 41, "a" * 40, "a" * 39, ("abc" * 30 + "x") * 4]
    check(spark, texts, 40, parts=2)


def test_length_of_the_query(spark):
    base = data.words(400, 9)
    edge = base[500:900]
    texts = [base, "one#" + edge + "#post", "two%" + base[500:899] + "%", "é" * 250, "x" + "é" * 199 + "é", "z" * 5000, "z" * 401, "z" * 400 + "q", None, None, "", "one", "one", base[:399], data.words(6000, 3), data.words(6000, 3)[:20000] + " end " + data.words(6000, 3)[20000:]]
    want = check(spark, texts, 400)
    assert want[1][1] == 400 and want[2][1] == 0


def test_awkward_rows(spark):
    _, rows = data.documents(spark)
    df = spark.createDataFrame(rows, data.KIND)
    got = data.rows_of(suffix_dedup.annotated(df).selectExpr("doc_id", "key", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", "repeats.kept_sha256"))
    assert got == collections.Counter((r[0], r[6], *w) for r, w in zip(rows, brute([r[1] for r in rows], 400)))
    assert suffix_dedup.annotated(df.limit(0)).count() == 0
    clean = {r["row"]: r["text"] for r in suffix_dedup.clean(df.where("doc_id = 5 or doc_id = 7")).collect()}
    assert set(clean.values()) <= {"", "one two"}
    with pytest.raises(ValueError):
        suffix_dedup.annotated(df, result="key")


def test_shard_order():
    """The order of suffixes and what neighbours share, against plain sorting."""
    r = np.random.default_rng(1)
    letter = r.integers(0, 3, 200).astype(np.uint64)
    ends = np.array([50, 51, 120, 200])
    left = ends[np.searchsorted(ends, np.arange(200), "right")] - np.arange(200)
    order, common = suffix_dedup.suffixes(letter, left, 200)
    suffix = [tuple(letter[i : i + left[i]].tolist()) for i in range(200)]
    assert [suffix[i] for i in order] == sorted(suffix)
    for k in range(1, 200):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
