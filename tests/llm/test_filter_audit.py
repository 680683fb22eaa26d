import collections
import itertools
import random
import re
from fractions import Fraction

from lotline.llm import filter_audit

from . import data

LETTERS = "ABCDE"


def brute(docs, labels):
    """Every document sent through every order of the filters."""
    texts = collections.defaultdict(list)
    for i, t, _ in docs:
        texts[t or ""].append(i)
    marks = collections.defaultdict(lambda: [0, 0])
    for i, q, x in labels:
        marks[i] = [max(marks[i][0], q == 1), max(marks[i][1], x == 1)]
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i for j in texts[t])}
        fails.append((part or "", {x for x in LETTERS if bad[x]}, *marks[i]))
    out = {}
    share = collections.Counter()
    for order in itertools.permutations(LETTERS):
        for part in {f[0] for f in fails}:
            left = [f for f in fails if f[0] == part]
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                every = [f for f in fails if f[0] == part and x in f[1]]
                out[part, "".join(order), step] = (len(left), len(gone), len(every) - len(gone), sum(f[1] == {x} for f in every), sum(f[2] for f in gone), sum(f[3] for f in gone))
                share[part, x] += len(gone)
    return collections.Counter((*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_equals_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " ", data.words(120, 1), data.words(120, 1), "same " * 150, data.words(130, 2).upper(), data.words(50, 3) + " $", "ab", "ab", "ÉÀ " * 60, "A b c d", data.words(20000, 5)]
    docs = [(i, r.choice(texts), r.choice(["en", "de", "", None])) for i in range(150)]
    docs += [docs[0], docs[0], (None, "ab", "en"), (None, None, None), (5, "ab", "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 1), (9999, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, lang string, mask string, n int")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert data.rows_of(got) == brute(docs, [x for x in labels if x[0] is not None])


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_polynomial():
    """Corners tell the survivors; the integral is the mean over orders, and all shares sum to what all filters remove."""
    r = random.Random(1)
    counts = {m: r.randrange(50) for m in range(16)}
    p = filter_audit.Removal(counts, 4)
    assert all(p.at(s) == sum(n for m, n in counts.items() if m & s) for s in range(16))
    for i in range(4):
        mean = Fraction(sum(p.at(sum(1 << j for j in o[: o.index(i) + 1])) - p.at(sum(1 << j for j in o[: o.index(i)])) for o in itertools.permutations(range(4))), 24)
        assert p.shapley(i) == mean
    assert sum(p.shapley(i) for i in range(4)) == p.at(15)
