import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lotline.llm import jaccard
from lotline.llm.common import components, maybe_among

from . import data


def test_divide_skip_equals_counting(monkeypatch):
    r = random.Random(5)
    for trial in range(300):
        lists = [sorted(r.sample(range(40), r.randint(1, 30))) for _ in range(r.randint(1, 25))]
        t = r.randint(1, 12)
        counts = Counter(x for a in lists for x in a)
        monkeypatch.setattr(jaccard, "HEAP", (10**9, 0)[trial % 2])
        assert jaccard.divide_skip([np.array(a, dtype=np.int64) for a in lists], t) == sorted(x for x, n in counts.items() if n >= t), (lists, t)


def test_local_search_finds_all_components():
    r = random.Random(6)
    for trial in range(40):
        base = [sorted(r.sample(range(5000), r.randint(20, 60))) for _ in range(3)]
        sets = []
        for _ in range(60):
            b = set(r.choice(base))
            for _ in range(r.randint(0, 9)):
                b.discard(r.choice(sorted(b)))
                b.add(r.randrange(10000))
            sets.append(np.array(sorted(b)))
        groups = jaccard.Groups(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if jaccard.linked(sets[i], sets[j]):
                    groups.join(i, j)
        mine = jaccard.Groups(len(sets))
        for i, j in jaccard.search(sets):
            assert jaccard.linked(sets[i], sets[j])
            mine.join(i, j)
        assert [mine.of(i) for i in range(len(sets))] == [groups.of(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(i + 1, i) for i in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (400, 400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def check(spark, df, rows):
    got = jaccard.groups(df).collect()
    assert len(got) == len(rows)
    of, sets = data.groups([r[1] for r in rows])
    least = {}
    for g, r in zip(of, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = Counter((r[0], len(s), least.get(g) if s else r[0]) for r, g, s in zip(rows, of, sets))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_awkward_rows(spark):
    df, rows = data.documents(spark)
    check(spark, df, rows)
    assert jaccard.groups(df.limit(0)).count() == 0
    kept = jaccard.deduplicated(df)
    of, sets = data.groups([r[1] for r in rows])
    assert kept.columns == df.columns
    assert kept.count() == len({g for g, s in zip(of, sets) if s}) + sum(not s for s in sets)
    renamed = jaccard.deduplicated(df.withColumnRenamed("key", "__row").withColumnRenamed("row", "__hit"))
    assert renamed.columns == [*df.columns[:-2], "__row", "__hit"] and data.rows_of(renamed) == data.rows_of(kept)


def test_common_passages_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 3000)
    r = random.Random(9)
    passage, base = data.words(50, 77), data.words(90, 78).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"w{r.randrange(999)}"
        text = " ".join(w) if i < 90 else passage + " " + data.words(r.choice([3, 8, 12, 60]), i % 40)
        rows.append((i, text, "en", "s", 0, 0, "", 0))
    check(spark, spark.createDataFrame(rows, data.KIND), rows)


def test_copies_make_no_pairs(spark, monkeypatch):
    counted, real = [], jaccard.written

    def told(df, name):
        out = real(df, name)
        if name == "jaccard-counted":
            counted.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", told)
    texts = [data.words(80 + 5 * i, 100 + i) for i in range(30)]
    for changed in (False, True):
        rows = [(i + 100 * k, t + f" end{k}" * changed, "en", "s", 0, 0, "", 0) for k in range(7) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, data.KIND)
        check(spark, df, rows)
        entries = sum(jaccard.prefix_size(len(data.shingles(r[1]))) for r in rows)
        assert counted.pop() < 0.2 * entries
        assert {r["doc_id"] for r in jaccard.deduplicated(df).select("doc_id").collect()} == set(range(30))


def _tables(monkeypatch):
    """Names and rows of the tables that are written from now on."""
    seen, real = [], jaccard.written

    def told(df, name):
        out = real(df, name)
        seen.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "written", told)
    return seen


def test_near_copies_make_pairs_in_turns(spark, monkeypatch):
    """Lists are written, not their pairs, and what is made of them at once is bounded."""
    monkeypatch.setattr(jaccard, "ALIKE", 10**9)
    monkeypatch.setattr(jaccard, "PAIRS", 6000)
    seen = _tables(monkeypatch)
    texts = [data.words(150 + 5 * i, 100 + i) for i in range(12)]
    rows = [(i + 100 * k, t + f" end{k}", "en", "s", 0, 0, "", 0) for k in range(12) for i, t in enumerate(texts)]
    check(spark, spark.createDataFrame(rows, data.KIND), rows)
    entries = sum(jaccard.prefix_size(len(data.shingles(r[1]))) for r in rows)
    assert dict(seen)["jaccard-counted"] < entries / 8
    assert 3 < sum(name == "jaccard-pairs" for name, _ in seen) and sum(n for name, n in seen if name == "jaccard-pairs") < 12 * 100


def test_sizes_too_far_apart_make_no_pairs(spark, monkeypatch):
    """A passage in texts of sizes that can't link doesn't tie them into one group."""
    seen = _tables(monkeypatch)
    passage = data.words(30, 77)
    rows = [(i, passage + " " + data.words(20 * 2**i, 50 + i), "en", "s", 0, 0, "", 0) for i in range(7)]
    check(spark, spark.createDataFrame(rows, data.KIND), rows)
    assert dict(seen)["jaccard-pairs"] == dict(seen)["jaccard-members"] == 0


def test_blocks_of_a_large_group_are_searched_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 600)
    seen = _tables(monkeypatch)
    r, base = random.Random(9), data.words(90, 78).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"w{r.randrange(999)}"
        rows.append((i, " ".join(w), "en", "s", 0, 0, "", 0))
    check(spark, spark.createDataFrame(rows, data.KIND), rows)
    assert sum(name == "jaccard-links" for name, _ in seen) > 2


def test_dropped_copies_are_not_shuffled(spark, monkeypatch):
    filtered, real = [], jaccard.maybe_among
    monkeypatch.setattr(jaccard, "maybe_among", lambda *a: filtered.append(real(*a)) or filtered[-1])
    rows = [(i + 100 * k, data.words(80, 100 + i) if i else "", "en", "s", 0, 0, "", 0) for k in range(7) for i in range(10)]
    kept = jaccard.deduplicated(spark.createDataFrame(rows, data.KIND))
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {*range(10), *range(0, 700, 100)}
    assert filtered[-1].where("__hit").count() < 10


def test_filter_keeps_all_keys(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    kept = {r["k"] for r in maybe_among(df, F.col("k"), df.where("k % 7 = 0").withColumnRenamed("k", "told")).where("__hit").collect()}
    assert {k for k in range(5000) if k % 7 == 0} <= kept and len(kept) < 1500
