import hashlib
import random
import re

import numpy as np

from lotline.llm import decontam

from . import data


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", data.lower(text))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        for j in range(len(v) - n + 1) if n else ():
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    hit |= set(range(i, i + n))
                    found |= {name} - {None}
    ids = sorted(map(str, found))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def brute_longest(text, items):
    """(words, first place) of the longest match of at least a window."""
    w, best = words(text), (0, 1)
    for _, item in items:
        v = words(item)
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= min(10, len(v)) and n:
                    best = max(best, (n, -i))
    return best[0], -best[1]


ITEMS = [(1, data.words(60, 2)), (2, "One two!"), (10, data.words(25, 11)), (3, data.words(25, 11)), (None, data.words(15, 12)), (4, None), (5, "..."), (6, "éß"), (7, "a a a a a a a a a a a a"), (1, data.words(60, 2))]


def check(spark, monkeypatch, rows, df, longest=True):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.annotated(df, bench).collect()
    assert len(got) == len(rows)
    want = {r[:2]: brute(r[1], ITEMS) for r in rows}
    for r in got:
        x = r["decontamination"]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == want[(r["doc_id"], r["text"])], r["text"]
        if longest and r["text"] and len(r["text"]) < 2000:
            assert (x["longest"], x["longest_at"]) == brute_longest(r["text"], ITEMS), r["text"]


def rows_with_hits(spark):
    df, rows = data.documents(spark)
    r = random.Random(3)
    w, v = ITEMS[0][1].split(), ITEMS[2][1].split()
    for i in range(40):
        a = r.randrange(40)
        rows.append((100 + i, " ".join([*data.words(5, i).split(), *w[a : a + r.randint(8, 14)], *(["x"] * (i % 2)), *v[: r.randint(8, 12)], "A", *["a"] * r.randint(0, 15)]), *[None] * 6))
    return spark.createDataFrame(rows, data.KIND), rows


def test_equals_brute_force(spark, monkeypatch):
    df, rows = rows_with_hits(spark)
    check(spark, monkeypatch, rows, df)
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 50)
    check(spark, monkeypatch, rows, df, False)


def test_common_prefixes_equal_plain_ones():
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(1, 40)
        letter = np.array([r.randint(0, 2) for _ in range(n)])
        after = np.array([i + 1 if i + 1 < n and r.random() < 0.9 else -1 for i in range(n)])

        def spell(i):
            out = []
            while i >= 0:
                out.append(letter[i])
                i = after[i]
            return out

        levels = decontam.doubled(letter, after)
        order = np.argsort(levels[0][-1], kind="stable").tolist()
        assert [spell(i) for i in order] == sorted(map(spell, range(n)))
        a, b = np.array([r.randrange(n) for _ in range(30)]), np.array([r.randrange(-1, n) for _ in range(30)])
        want = [next((k for k, (x, y) in enumerate(zip(spell(i), spell(j))) if x != y), min(len(spell(i)), len(spell(j)))) if j >= 0 else 0 for i, j in zip(a, b)]
        assert decontam.common_prefix(a, b, levels).tolist() == want


def test_a_passage_of_many_items_many_times(spark):
    """As many rows are made as places match, not places times items."""
    passage = data.words(30, 60)
    bench = spark.createDataFrame([(i, f"{passage} tail{i}") for i in range(3000)], "item_id long, text string")
    df = spark.createDataFrame([(0, " ".join([passage] * 800)), (1, passage + " tail7"), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["decontamination"] for r in decontam.annotated(df, bench).collect()}
    assert [got[i]["n_items"] for i in range(3)] == [3000, 3000, 0] and got[1]["longest"] == 31 and got[1]["longest_item"] == "7"
    assert got[0]["n_hit"] == 24000 and got[0]["longest"] == 30


def test_longest_match_and_cleaning(spark):
    item = data.words(30, 50)
    texts = [item, "zz " + " ".join(item.split()[3:18]) + " yy", " ".join(item.split()[:9]), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r["decontamination"] for r in decontam.annotated(df, bench).collect()}
    assert [(got[i]["longest"], got[i]["longest_at"], got[i]["longest_from"]) for i in range(4)] == [(30, 0, 0), (15, 1, 3), (0, -1, -1), (0, -1, -1)]
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontam.clean(df, bench.limit(0)).count() == 4 and decontam.clean(df.limit(0), bench).count() == 0
