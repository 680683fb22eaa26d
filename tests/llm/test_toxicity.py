import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lotline.llm import toxicity

from . import data

BAD = ["grumble", "snorkle", "blister"]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        w = data.words(40, i).split()
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(40), r.choice(BAD))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), None))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_held_out_and_disguised(spark, tables):
    docs, labels = tables
    new = [(1000 + i, t, None) for i, t in enumerate(["grumble", "grümb1e", "s n 0 r k l e", "sn0rk1e!!", "bl1$ter", "blllister", "b.l.i.s.t.e.r", "calm words only", "", None, "a b c d e f g h", "SNORKLE " + data.words(3000, 9)])]
    got = toxicity.scored(docs.unionByName(spark.createDataFrame(new, docs.schema)), labels).collect()
    score = {r["doc_id"]: r["toxicity_score"] for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((score[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert [int(score[1000 + i] >= 0.5) for i in range(12)] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1]


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    some = docs.limit(30)
    a, b = (sorted((r["doc_id"], r["toxicity_score"]) for r in toxicity.scored(docs, x).where("doc_id < 30").collect()) for x in (labels, flipped))
    assert a == b and some.count() == 30


def test_awkward_rows(spark, tables):
    df, rows = data.documents(spark)
    assert toxicity.scored(df, tables[1].limit(0)).count() == len(rows)
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 0)], "doc_id long, toxic int")
    assert toxicity.scored(df, odd).count() == len(rows)
    assert toxicity.clean(df.limit(0), tables[1]).count() == 0


def model(words, n=1000):
    counts, context = Counter(), Counter()
    for w in words:
        w = toxicity.BEGIN * toxicity.ORDER + w + toxicity.STOP
        for i in range(len(w) - toxicity.ORDER):
            for k in range(toxicity.ORDER + 1):
                counts[w[i + k : i + toxicity.ORDER + 1]] += n
                context[w[i + k : i + toxicity.ORDER]] += n
    return toxicity.Model(counts, context)


def reader(words, stems=()):
    return toxicity.Reader(words, list(stems), model(words))


def test_viterbi_equals_enumeration():
    """The restored word is the best of all paths through the lattice, each scored by itself."""
    m, r = model(["bilge", "glass", "tool", "loose", "east", "oil"], 7), random.Random(3)
    for _ in range(300):
        seen = "".join(r.choice("bilgeasto013!|$@*855") * r.choice((1, 1, 1, 2, 3)) for _ in range(r.randint(1, 7)))
        scores = {}
        for path in itertools.product(*toxicity.lattice(seen)):
            word = "".join(x for x, _ in path)
            s = sum(c for _, c in path) + toxicity.spelled(m, toxicity.BEGIN * toxicity.ORDER, word + toxicity.STOP)[0]
            scores[word] = max(s, scores.get(word, -1e9))
        got = toxicity.restore(seen, m)
        assert scores[got] >= max(scores.values()) - 1e-9, (seen, got)


def test_features_are_those_of_the_restored_text():
    """Decoding only what may lead to a word gives what decoding all does."""
    words, stems = ["idiot", "hello", "blister", "sassy"], ["blis", "grum"]
    full, plain = reader(words, stems), random.Random(5)
    swap = {"i": "1!", "o": "0", "e": "3", "s": "5$", "l": "1|", "t": "7+", "a": "4@", "b": "8", "g": "6"}
    for trial in range(200):
        tokens = []
        for _ in range(plain.randint(1, 12)):
            w = plain.choice([*words, "grumble", "calm", "tone", "blis", "stab"])
            w = "".join(plain.choice(swap.get(c, c)) if plain.random() < 0.3 else c * plain.choice((1, 1, 1, 3)) for c in w)
            tokens.append(plain.choice(["", "**", "!!", "&"]) + w + plain.choice(["", "***", "!!", "."]))
            if trial % 3 == 0:
                tokens += list(plain.choice(["b a l l", "i d 1 o t", "he ll o"]).split())
        text = " ".join(tokens)
        seen = full.restored(text).split()
        want = {full.index[w] for w in seen if w in full.index}
        got = {i for i in full(text) if i < len(words)}
        assert got >= want and got - want <= {full.index[w] for t in tokens for w in re.findall("[a-z]+", t) if w in full.index} | {full.index[w] for w in map(lambda f: full.known_as(f), (f for t in tokens for f in full.forms(t))) if w in full.index} | {full.index[w] for a, b in full.stretches(tokens) for w in full.spaced(tokens[a:b]).values()}


def test_grams_of_wanted_words_are_those_of_all_texts(spark):
    texts = ["bilge glass", "bilge oil", "b1lge tool", None, "", "stool glas"]
    got = toxicity.grams(spark.createDataFrame([(t,) for t in texts], "text string"), "text", ["bilge", "tool"])
    want = model(["bilge", "glass", "bilge", "oil", "b", "lge", "tool", "stool", "glas"], 1)
    for w in ("bilge", "tool", "bblge"):
        w = toxicity.BEGIN * toxicity.ORDER + w + toxicity.STOP
        for i in range(len(w) - toxicity.ORDER):
            assert got(w[i : i + toxicity.ORDER], w[i + toxicity.ORDER]) == want(w[i : i + toxicity.ORDER], w[i + toxicity.ORDER])


def test_restored_text_is_a_column(spark, tables):
    docs, labels = tables
    new = spark.createDataFrame([(1000, "a sn0rk1e!! of ca1m", None)], docs.schema)
    got = toxicity.scored(docs.unionByName(new), labels, restored="restored").where("doc_id = 1000").first()
    assert got["restored"].split()[:3] == ["a", "snorkle", "of"] and got["toxicity_score"] >= 0.5


@pytest.mark.parametrize("sign", toxicity.SIGNS)
def test_each_sign_stands_for_each_of_its_letters_and_may_be_left_out(sign):
    for letter in toxicity.SIGNS[sign]:
        word = f"qu{letter}nk"
        assert reader([word])(f"so qu{sign}nk here") == [0], letter
    assert reader(["vohum"])(f"v{sign}o{sign}h{sign}u{sign}m") == [0]


def test_look_up_is_as_wide_as_the_lattice():
    r = reader(["bad", "hello", "evil"])
    assert [r(x) for x in ("6ad", "b|a|d", "b!a!d", "[b]a{d}", "b>a?d", "he££o", "evi!", "ba d", "b a d", "b\na\n\nd", "b  a   d")] == [[0]] * 5 + [[1], [2]] + [[0]] * 4
    assert r("a d b calm ba") == [] and r("no evi or hel") == []


def all_stretches(r, pieces):
    """Every stretch of pieces tried from every start, as long as any beginning is open."""
    pieces, found = [toxicity.fold(x) for x in pieces], set()
    for i in range(len(pieces) - 1):
        begun, _ = r.after({""}, pieces[i])
        for j in range(i + 1, len(pieces)):
            begun, _ = r.after(begun, pieces[j])
            if not begun - {""}:
                break
            if not begun.isdisjoint(r.skeletons) and (word := toxicity.restore("".join(pieces[i : j + 1]), r.model)) in r.index:
                found.add(word)
    return found


def test_spaced_words_are_those_of_all_stretches():
    r = reader(["bad", "ball", "oops", "idiot", "add", "as", "ass", "gab"])
    rand = random.Random(8)
    for _ in range(400):
        pieces = []
        for _ in range(rand.randint(1, 4)):
            w = rand.choice(["bad", "ball", "oops", "idiot", "add", "ass", "xyz", "boa", "sa"])
            for c in w:
                pieces += [rand.choice([c, c, c, {"a": "4", "o": "0", "s": "$", "i": "1"}.get(c, c)])] * rand.choice((1, 1, 1, 1, 2, 4))
                pieces += [rand.choice("-*.")] * (rand.random() < 0.15)
        pieces = [p + (rand.choice("ab") if rand.random() < 0.1 else "") for p in pieces]
        assert set(r.spaced(pieces).values()) == all_stretches(r, pieces), pieces


@pytest.mark.parametrize("text", ["a " * 20_000, "a - " * 20_000, "a b " * 20_000, "a s s " * 10_000, "? " * 30_000, "a " + "? " * 30_000 + "s s", "a1" * 100_000, "4 " * 20_000, "b 4 ll " * 9_000])
def test_long_texts_of_short_pieces(text):
    """The time grows with the length: tens of thousands of words take seconds."""
    import time

    r = reader(["ass", "ball", "abba", "add"], ["abas"])
    r("warm up")
    began = time.process_time()
    r(text)
    assert time.process_time() - began < 10
