"""Toxicity of texts whose words may be disguised: noisy-channel restoring, then a word classifier."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows that the classifier is fitted on at most (those of the lowest hashes).
FIT_ROWS = 20_000
#: Words that are features, the toxic documents each must be in, its least chi-square, and the weight of the ridge.
FEATURES, SUPPORT, TYPICAL, RIDGE = 300, 3, 15.0, 1.0
#: Letters before a letter that the character model looks at, and what stands before and after a word.
ORDER, BEGIN, STOP = 4, "\x02", "\x03"
#: Lengths of word beginnings (stems) that may be typical, the share of a document's words that makes one frequent in it, and the most that are kept.
STEMS, FREQUENT, MOST_STEMS = range(4, 9), 0.004, 200
#: Shares of typical stems in a text's words, and numbers of them, that are features.
SHARES, NUMBERS = (0.001, 0.0025, 0.005, 0.0075, 0.01, 0.0125, 0.015, 0.02, 0.03, 0.05), (1, 2, 3, 5)

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s"}
#: Cyrillic and Greek letters that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕкмнтвαοερντικ", "aeopcyxijskmhtbaoepvtik"))
#: Characters of a piece of a word with blanks in it, at most.
PIECE = 2
#: Places where a word with blanks in it may have begun that are looked at, the nearest ones.
STARTS = 3
#: Tokens whose features are remembered: so many, none longer than so many characters.
REMEMBERED, SHORT = 500_000, 40
#: What most tokens tell, held once.
NOTHING = ((), False)
#: Log-probabilities of the channel: a letter as it is, by a sign, written more than once, a mark left out.
KEPT, SIGNED, REPEATED, DROPPED = log(0.9), log(0.04), log(0.03), log(0.03)

_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+[.,;:?]?\Z")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00a3\u00a7\u20ac"
_BLANK_MARKS = "".join(c for c in _MARKS if c not in SIGNS)
_BETWEEN = re.compile(r"[\s.,\-_*~'`^/\\:;#%&=\"]+")


class _Folded(dict):
    """What each character becomes, found when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        return out


_FOLDED = _Folded()


def fold(text: str) -> str:
    """Lower case without accents, with look-alike letters as Latin ones."""
    return text.lower() if text.isascii() else text.lower().translate(_FOLDED)


def letters(token: str) -> list[str]:
    """The stretches of letters in a token."""
    return [token] if token.isascii() and token.isalpha() else _LETTERS.findall(token)


def _classes() -> dict[str, str]:
    """The least letter of those that signs connect, for each such letter and sign."""
    out: dict[str, str] = {}
    for sign, letters in SIGNS.items():
        joined = {out.get(x, x) for x in (sign, *letters)}
        least = min(x for x in joined if x.isalpha())
        out |= {x: least for x, y in out.items() if y in joined} | {x: least for x in (sign, *letters)}
    return out


_CLASS = _classes()
_SHAPE, _FOR_SIGNS = str.maketrans(_CLASS), set("".join(SIGNS.values()))
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def skeleton(text: str) -> str:
    """One letter for all letters and signs that are connected, each run once: equal for a word and its disguises without left-out signs."""
    return _RUN.sub(r"\1", text.translate(_SHAPE))


class Model:
    """A back-off character model: log P(letter | letters before) from counts of n-grams and of their contexts."""

    def __init__(self, counts: dict[str, int], context: dict[str, int]):
        self.counts, self.context, self.known = counts, context, {}

    def __call__(self, before: str, letter: str) -> float:
        out = self.known.get(before + letter)
        if out is None:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[before + letter] = out = self.found(before, letter)
        return out

    def found(self, before: str, letter: str) -> float:
        p, weight = 0.0, 1.0
        for k in range(len(before) + 1):
            total = self.context.get(before[k:], 0)
            if total:
                p += weight * 0.8 * self.counts.get(before[k:] + letter, 0) / total
                weight *= 0.2
        return log(p + weight * 1e-3)


def lattice(seen: str) -> list[list[tuple[str, float]]]:
    """For each run of one character the letters that may be behind it, with the channel's log-probability.

    A letter stands for itself, a sign for each letter of SIGNS, a run of one
    letter for one or two of it; what is no letter may be left out.
    """
    out = []
    for m in re.finditer(r"(.)\1*", _BETWEEN.sub("", seen), re.DOTALL):
        c, n = m[1], len(m[0])
        letters = {*SIGNS.get(c, ""), *(c if c.isalpha() else "")}
        arcs = [(x * k, (KEPT if x == c else SIGNED) + REPEATED * (n != k)) for x in sorted(letters) for k in sorted({1, min(n, 2)})]
        out.append(arcs if c.isalpha() else [*arcs, ("", DROPPED * n)])
    return out


def spelled(model: Model, before: str, letters: str) -> tuple[float, str]:
    """log P of more letters after a state (the last ORDER letters), and the state then."""
    total = 0.0
    for x in letters:
        total += model(before, x)
        before = (before + x)[-ORDER:]
    return total, before


def restore(seen: str, model: Model) -> str:
    """The likeliest word behind a disguised one: Viterbi keeps the best path through the lattice into each state, the last ORDER letters."""
    best = {BEGIN * ORDER: (0.0, "")}
    for arcs in lattice(seen):
        after: dict[str, tuple[float, str]] = {}
        for state, (score, word) in best.items():
            for add, cost in arcs:
                s, now = spelled(model, state, add)
                s += score + cost
                if now not in after or s > after[now][0]:
                    after[now] = (s, word + add)
        best = after
    return max(((s + model(state, STOP), word) for state, (s, word) in best.items()), default=(0, ""))[1]


class Reader:
    """Restores texts, and tells the features of a restored text: which of the words it holds, and how many typical stems.

    Every token that isn't plain letters is read through the lattice. As only
    words and stems count, known_as() first asks whether any path of the lattice
    leads to one (an exact test, without the model) and decodes only then;
    restored() decodes all.
    """

    def __init__(self, words: list[str], stems: list[str], model: Model):
        self.index = {w: i for i, w in enumerate(words)}
        self.stems, self.lengths = set(stems), sorted({len(x) for x in stems})
        self.width = len(words) + len(SHARES) + len(NUMBERS)
        self.skeletons, self.starts = {skeleton(w) for w in words}, {skeleton(w) for w in stems}
        self.begun = {x[:n] for x in self.skeletons | self.starts for n in range(len(x) + 1)}
        self.model, self.known, self.moved = model, {}, {}

    def typical(self, word: str) -> bool:
        for n in self.lengths:
            if word[:n] in self.stems:
                return True
        return False

    def token(self, token: str) -> tuple[tuple[int, ...], bool]:
        """The features of a token as it stands and restored, and whether it begins with a typical stem."""
        word = token if token.isalpha() else token[:-1]
        if word.isascii() and word.isalpha() and _PLAIN.match(token) and not _DOUBLE.search(word):
            return (self.index[word],) if word in self.index else (), self.typical(word)
        parts = _LETTERS.findall(token)
        found = {self.index[w] for w in parts if w in self.index}
        typical = any(map(self.typical, parts))
        if not _PLAIN.match(token):
            for form in self.forms(token):
                word = self.known_as(form)
                found |= {self.index[word]} if word in self.index else set()
                typical = typical or self.typical(word)
        elif not token.isascii() or _DOUBLE.search(token):
            word = self.known_as(fold(token).rstrip(".,;:!?"))
            found |= {self.index[word]} if word in self.index else set()
        return tuple(sorted(found)), typical

    def forms(self, token: str) -> list[str]:
        """A token without marks at its ends, and with those that may stand for letters."""
        token = fold(token).strip(_BLANK_MARKS)
        left = token.lstrip(_MARKS)
        return list(dict.fromkeys((token, token.rstrip(_MARKS), left, left.rstrip(_MARKS))))

    def after(self, begun: set[str], text: str) -> tuple[set[str], bool]:
        """The beginnings of skeletons that the lattice can be at after more text, and whether a stem was complete: letters and signs go on or repeat, all but letters may be left out."""
        stem = False
        for c in text:
            letter = c.isalpha()
            now = set() if letter else set(begun)
            if letter or c in SIGNS:
                x = _CLASS.get(c, c)
                for s in begun:
                    if s[-1:] == x:
                        now.add(s)
                    if s + x in self.begun:
                        now.add(s + x)
                        stem = stem or s + x in self.starts
            if not now:
                return now, stem
            begun = now
        return begun, stem

    def moves(self, state: str, piece: str) -> tuple[str, ...]:
        """The beginnings that one may be at after a piece, remembered."""
        out = self.moved.get((state, piece))
        if out is None:
            if len(self.moved) > REMEMBERED:
                self.moved.clear()
            self.moved[state, piece] = out = tuple(s for s in self.after({state}, piece)[0] if s)
        return out

    def known_as(self, form: str) -> str:
        """The word behind a form if some path of its lattice is a word or begins with a stem; else none."""
        begun, stem = self.after({""}, form)
        return restore(form, self.model) if stem or not begun.isdisjoint(self.skeletons) else ""

    def spaced(self, pieces: list[str]) -> dict[tuple[int, int], str]:
        """The words behind stretches (from, to) of short pieces with blanks between, in one pass.

        For each beginning of a skeleton that is open, the last STARTS places where
        it may have begun are kept: an earlier one tells a longer run of the same
        letter, which reads alike. A complete skeleton is decoded when it comes to
        be and while its last letter is repeated as often; what goes on without
        end ("a a a ...") is not decoded again and again.
        """
        found: dict[tuple[int, int], str] = {}
        if len(pieces) == 2 and not (self.moves("", fold(pieces[0]))):
            return found
        pieces = [fold(x) for x in pieces]
        live: dict[str, list[tuple[int, int]]] = {}
        for j, piece in enumerate(pieces):
            new: dict[str, list[tuple[int, int]]] = {}
            for state, starts in [("", [(j, 0)]), *live.items()]:
                for s in self.moves(state, piece):
                    new.setdefault(s, []).extend((i, still + 1 if s == state else 0) for i, still in starts)
            live = {s: sorted(set(x), reverse=True)[:STARTS] for s, x in new.items()}
            for s in live.keys() & self.skeletons:
                for i, still in live[s]:
                    if i < j and still < STARTS and (word := restore("".join(pieces[i : j + 1]), self.model)) in self.index:
                        found[i, j + 1] = word
        return found

    @staticmethod
    def stretches(tokens: list[str]) -> list[tuple[int, int]]:
        """Where two or more tokens of at most PIECE characters follow each other."""
        short = np.fromiter(map(len, tokens), np.int32, len(tokens)) <= PIECE
        edge = np.flatnonzero(np.diff(short, prepend=False, append=False)).tolist()
        return [(i, j) for i, j in zip(edge[::2], edge[1::2]) if j - i > 1]

    def restored(self, text: str | None) -> str:
        """The lower-cased text with each token that isn't plain as the likeliest word, where one form of it is a known word as that, and spaced words joined."""
        tokens = (text or "").lower().split()
        out = []
        for t in tokens:
            if _PLAIN.match(t) and (t.isascii() and not _DOUBLE.search(t)):
                out.append(t)
                continue
            words = [restore(f, self.model) for f in (self.forms(t) if not _PLAIN.match(t) else [fold(t).rstrip(".,;:!?")])]
            known = [w for w in words if w in self.index] or [w for w in words if self.typical(w)]
            out.append(known[0] if known else t if _PLAIN.match(t) else words[-1])
        for a, b in self.stretches(tokens):
            at = a
            for (i, j), word in sorted(self.spaced(tokens[a:b]).items(), key=lambda x: (x[0][0], -x[0][1])):
                if a + i >= at:
                    out[a + i : a + j] = [word, *[""] * (j - i - 1)]
                    at = a + j
        return " ".join(filter(None, out))

    def __call__(self, text: str | None) -> list[int]:
        found: set[int] = set()
        low, known = (text or "").lower(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        total = typical = 0
        tokens = low.split()
        for t, n in Counter(tokens).items():
            hit = known.get(t)
            if hit is None:
                hit = self.token(t)
                if len(t) <= SHORT:
                    known[t] = hit if hit != NOTHING else NOTHING
            if hit[0]:
                found.update(hit[0])
            typical += n * hit[1]
            total += n
        base = len(self.index)
        found.update(base + i for i, x in enumerate(SHARES) if typical > x * total)
        found.update(base + len(SHARES) + i for i, x in enumerate(NUMBERS) if typical >= x)
        for i, j in self.stretches(tokens):
            found.update(self.index[w] for w in self.spaced(tokens[i:j]).values())
        return sorted(found)


def pieces_of(words: list[str]) -> set[str]:
    """All that the n-grams and contexts in lattices of words look like as skeletons."""
    out = {""}
    for w in words:
        x = BEGIN + skeleton(w) + STOP
        out |= {x[i:j] for i in range(len(x)) for j in range(i + 1, min(i + ORDER + 1, len(x)) + 1)}
    return out


def asked(gram: str, pieces: set[str]) -> bool:
    """Whether a gram looks like a piece, or would without one letter that is read for a sign."""
    return skeleton(gram) in pieces or any(c in _FOR_SIGNS and skeleton(gram[:i] + gram[i + 1 :]) in pieces for i, c in enumerate(gram))


def grams(docs: DataFrame, text: str, words: list[str]) -> Model:
    """The character model from the words of all documents, with every n-gram that lattices of the given words ask for.

    Each task counts its words, then the n-grams of distinct words; the sums are
    Spark's. Words are folded, of letters only, between BEGIN and STOP. The
    longest n-grams are counted; the shorter ones are sums over all of them. What
    reaches the driver is bounded by the given words and their spellings, not by
    the documents: n-grams that look like no piece of theirs, even with a letter
    for a sign that should be left out, count as unseen.
    """
    pad = BEGIN * ORDER
    wanted = docs.sparkSession.sparkContext.broadcast(pieces_of(words))

    def count(batches):
        for batch in batches:
            words: Counter = Counter()
            for x in batch.column(0).to_pylist():
                words.update((x or "").lower().split())
            out: dict[str, int] = {}
            for token, n in words.items():
                for w in letters(fold(token)):
                    w = pad + w + STOP
                    for i in range(len(w) - ORDER):
                        g = w[i : i + ORDER + 1]
                        out[g] = out.get(g, 0) + n
            yield told(out, "gram")

    def told(out, name):
        return pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], names=[name, "n"])

    def shorter(batches):
        kept = wanted.value
        for batch in batches:
            out: dict[str, int] = {}
            for g, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in range(ORDER + 1):
                    for x, kind in ((g[k:], "n"), (g[k:-1], "c")):
                        if asked(x, kept):
                            out[kind + x] = out.get(kind + x, 0) + n
            yield told(out, "gram")

    sums = docs.select(text).mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = sums.mapInArrow(shorter, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return Model(*({r["gram"][1:]: r["n"] for r in rows if r["gram"][0] == kind} for kind in "nc"))


def _words(rows: DataFrame) -> DataFrame:
    """(word, n1, n0): toxic and other documents of (text, toxic) that hold each word, and "^" + each stem frequent in them."""

    def count(batches):
        for batch in batches:
            sums = (Counter(), Counter())
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = Counter(_LETTERS.findall((x or "").lower()))
                sums[y].update(words.keys())
                stems: Counter = Counter()
                for w, n in words.items():
                    for k in STEMS:
                        if len(w) >= k:
                            stems["^" + w[:k]] += n
                least = max(2, FREQUENT * words.total())
                sums[y].update(k for k, n in stems.items() if n >= least)
            for y in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(sums[y]), pa.string()), pa.array(list(sums[y].values()), pa.int64()), pa.array([y] * len(sums[y]), pa.int32())], names=["word", "n", "y"])

    counted = rows.select("text", "toxic").mapInArrow(count, "word string, n long, y int")
    return counted.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))


def logistic(rows: list[list[int]], y: np.ndarray, width: int) -> np.ndarray:
    """Ridge logistic regression on sets of features by Newton steps; the last weight is the constant's."""
    x = np.zeros((len(rows), width + 1))
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    w = np.zeros(width + 1)
    ridge = np.full(width + 1, RIDGE)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[Reader, np.ndarray]:
    """The reader and weights from labelled rows outside the held-out fifth.

    Words, and stems that are frequent in documents, are features by the
    chi-square of how many more toxic documents than their share hold them.
    Without both labels, or without
    documents, the score is a constant.
    """
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("toxic"))
    told = told.orderBy(F.md5(F.col(key).cast("string")), key).limit(FIT_ROWS)
    rows = written(docs.select(key, F.col(text).alias("text")).join(F.broadcast(told), key).select("text", "toxic"), "toxicity-rows")
    n1, n0 = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    share = n1 / max(n1 + n0, 1)
    chi2 = F.expr(f"pow(n1 - (n1 + n0) * {share}, 2) / ((n1 + n0) * {share} * {1 - share})")
    words, stems = [], []
    if n1 and n0:
        marked = written(_words(rows).where(F.col("n1") >= SUPPORT).where(F.col("n1") > (F.col("n1") + F.col("n0")) * share).withColumn("chi2", chi2).where(F.col("chi2") > TYPICAL), "toxicity-words")
        best = lambda stem, most: [r["word"] for r in marked.where(F.startswith("word", F.lit("^")) == stem).orderBy(F.desc("chi2"), "word").limit(most).select("word").collect()]
        words, stems = best(False, FEATURES), [w[1:] for w in best(True, MOST_STEMS)]
    reader = Reader(words, stems, grams(docs, text, words + stems))

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([reader(x) for x in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], names=["f", "toxic"])

    seen = rows.mapInArrow(features, "f array<int>, toxic int").collect()
    y = np.array([r["toxic"] for r in seen], dtype=float)
    return reader, logistic([r["f"] for r in seen], y, reader.width) if len(seen) else np.zeros(reader.width + 1)


RESULT = "toxicity_score"


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", restored: str | None = None) -> DataFrame:
    """All columns of docs and toxicity_score, 0 to 1, of the restored text; that text too, if restored names a column for it.

    Whole texts are read in tasks that hold the model (bounded by FEATURES and
    MOST_STEMS); no documents are shuffled. Null and empty texts get the score of
    a text without any of the words. Of a document with several labels the
    largest counts. docs must have no column toxicity_score.
    """
    if RESULT in docs.columns or restored in docs.columns:
        raise ValueError(f"{RESULT} or {restored} is a column of the documents")
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, key, text))
    names = [RESULT, *([restored] if restored else [])]

    def run(batches):
        reader, w = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            score = [1 / (1 + np.exp(-np.clip(w[reader(x)].sum() + w[-1], -30, 30))) for x in texts]
            more = [pa.array([reader.restored(x) for x in texts], pa.string())] if restored else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64()), *more], names=[*batch.schema.names, *names])

    from pyspark.sql.types import StructType

    kind = StructType([*docs.schema.fields])
    for name, t in zip(names, ("double", "string")):
        kind = kind.add(name, t)
    return docs.mapInArrow(run, kind)


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with a score under one half."""
    return scored(docs, labels, key, text).where(F.col(RESULT) < 0.5).drop(RESULT)
