"""Small tables with awkward rows, and plain versions of what the operators compute."""

import collections
import random
import re

KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key string, row long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, and columns with other meanings."""
    base = words(120, 1)
    near = base.split()
    near[60] = "changed"
    far = base.split()
    for i in range(0, 120, 15):
        far[i] = "other"
    passage = words(60, 2)
    texts = [base, base, " ".join(near), " ".join(far), None, "", " \t\n", "one two", "One  TWO", "one", words(6000, 3), words(6000, 3) + " end", passage + " " + words(40, 4), passage + " " + words(300, 5), "x" * 30000, "\u00e9\u00df \U0001f600 " * 20, "a@b.cd +49 (030) 123-4567 1.2.3.4 4111 1111 1111 1111 idiot"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "") , 1, "k", 5) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "one two three four five six", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "same id another text of eight plain words", "en", None, 9, 1, "k", 5)]
    return spark.createDataFrame(rows, KIND), rows


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(texts):
    """For each text the least position of the texts that links reach."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def of(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = of(i), of(j)
                up[max(x, y)] = min(x, y)
    return [of(i) for i in range(len(sets))], sets


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())
