"""N-gram Jaccard join by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections import Counter
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, forget, maybe_among, written

N = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A shingle in this share of all documents is common; common shingles come last in prefixes.
COMMON = 0.0005
#: Share of its shingles, beside the first, that a set's prefix has beyond what a meeting needs: as many must be shared.
EXTRA = 0.05
#: Sets that have so many lowest shingles (common ones left out) in common stand as one in lists.
ALIKE = 4
#: Longest list whose pairs are counted.
LIST = 24
#: Pairs that are counted at once: so many a shingle of all documents, or PAIRS where that is more. Names, lists or documents in one piece of a batch.
PAIR_SHARE, PAIRS, PIECE = 1 / 16, 4_000_000, 1024
#: Shingles that one task searches at once; larger groups are searched in pairs of blocks.
GROUP_SHINGLES = 1_500_000
#: Groups are searched in rounds; the sets of one have this share of all documents' shingles, at most about it.
ROUND = 0.5
#: Leading documents that each document is compared with before the search, and DivideSkip's weight of a probe.
LEADERS, MU = 12, 0.01
#: Entries of short lists from which on they are merged by a sort instead of a heap.
HEAP = 400
#: Bytes of text that are hashed together.
CHUNK_BYTES = 4 << 20

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = 0xD6E8FEB86659FD93
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUE = np.random.default_rng(41).integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of texts.

    Words are hashed as polynomials of their bytes (A-Z as a-z), read off the
    running sums of a whole chunk of texts, so no step is made a word or a byte.
    """

    def __init__(self, n: int = N):
        self.n = n
        self._powers(1 << 16)

    def _powers(self, size: int) -> None:
        with np.errstate(over="ignore"):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, r, np.uint64)])) for r in (_STEP, pow(_STEP, -1, 2**64)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out, held, size = [], [], 0
        for x in texts:
            held.append((x or "").encode())
            size += len(held[-1])
            if size > CHUNK_BYTES:
                out += self._chunk(held)
                held, size = [], 0
        return out + self._chunk(held) if held else out

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and how many words each text has."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if len(data) >= len(self.up):
            self._powers(2 * len(data))
        blank = _BLANK[data]
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_VALUE[data] * self.up[: len(data)], out=sums[1:])
        words = (sums[end] - sums[start]) * self.down[start]
        words = (words ^ (words >> np.uint64(32))) * _MIX[0]
        stops = np.cumsum([len(t) + 1 for t in texts])
        return words ^ (words >> np.uint64(29)), np.diff(np.searchsorted(start, stops), prepend=0)

    def _fold(self, words: np.ndarray, size: int) -> np.ndarray:
        out = np.full(max(len(words) - size + 1, 0), size, dtype=np.uint64)
        for i in range(size):
            out = (out ^ words[i : i + len(out)]) * _MIX[0]
            out ^= out >> np.uint64(29)
        out = (out ^ (out >> np.uint64(30))) * _MIX[1]
        out = (out ^ (out >> np.uint64(27))) * _MIX[2]
        return (out ^ (out >> np.uint64(31))).view(np.int64)

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            words, count = self._words(texts)
            every = self._fold(words, self.n)
            at = np.concatenate([[0], np.cumsum(count)])
            return [np.unique(every[a : b - self.n + 1]) if b - a >= self.n else self._fold(words[a:b], b - a) if b > a else np.zeros(0, np.int64) for a, b in zip(at, at[1:])]


def required(n: int) -> int:
    """Shingles that a set's prefix shares with that of any set it links with (the less of both counts)."""
    return 1 + int(EXTRA * n)


def prefix_size(n: int) -> int:
    """Of two linked sets, prefixes of this size share required() shingles, in any common order."""
    return min(n, n - -(-PERCENT * n // 100) + required(n)) if n else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _common(docs: DataFrame, text: str) -> np.ndarray:
    """The common shingles, sorted: at most mean set size / COMMON of them, whatever the number of documents.

    Each task counts its shingles and sends those that reach the share among its
    own documents (a shingle that is common everywhere is so in some task). The
    set only orders prefixes; results don't depend on it.
    """

    def local(batches):
        shingle = Shingler()
        for batch in batches:
            texts, sets = batch.column(0), []
            for at in range(0, len(texts), PIECE):
                # prefixes take the lowest hashes: what is common above them plays no part
                sets += [s[: 2 * prefix_size(len(s))].copy() for s in shingle(texts.slice(at, PIECE).to_pylist())]
            keys, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int64),) * 2
            often = n >= max(2, int(COMMON * len(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[often]), pa.array(n[often])], names=["shingle", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(texts)])], names=["shingle", "n"])

    counts = written(docs.select(text).mapInArrow(local, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "jaccard-counts")
    total = counts.where("shingle is null").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("shingle").isNotNull() & (F.col("n") >= max(8, COMMON * total))).select("shingle").toPandas()
    forget(counts)
    return np.sort(rows["shingle"].to_numpy(dtype=np.int64))


def _signed(docs: DataFrame, key: str, text: str, common) -> DataFrame:
    """A row a document: row, key, text's hash, n, set's hash, the name of those alike and the prefix of its set, rarest order first; written.

    Equal sets are alike, and so are those whose ALIKE lowest shingles are equal, as most near copies' are.
    """

    def run(batches):
        shingle, often = Shingler(), common.value
        for batch in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            n, high, low, alike, prefixes, salted = [], [], [], [], [], []
            for s in shingle(batch.column(3).to_pylist()):
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                at = np.minimum(np.searchsorted(often, s), max(len(often) - 1, 0))
                is_common = often[at] == s if len(often) else np.zeros(len(s), dtype=bool)
                order = np.concatenate([s[~is_common], s[is_common]])[: prefix_size(len(s))]
                n.append(len(s))
                high.append(int.from_bytes(digest[:8], "little", signed=True))
                low.append(int.from_bytes(digest[8:], "little", signed=True))
                prefixes.append(order)
                salted.append(min(int((~is_common).sum()), len(order)))
                lowest = hashlib.blake2b(order[:ALIKE].tobytes(), digest_size=8).digest() if salted[-1] >= ALIKE else digest[8:]
                alike.append(int.from_bytes(lowest, "little", signed=True))
            size = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(alike, pa.int64()), lists, pa.array(salted, pa.int64())], names=["row", "key", "told", "n", "high", "low", "alike", "prefix", "rare"])

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("told"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return written(source.mapInArrow(run, f"row long, key {kind}, told long, n long, high long, low long, alike long, prefix array<long>, rare long"), "jaccard-sets")


def _pairs(counted: DataFrame, turn: int, turns: int) -> DataFrame:
    """(a, b, need) for each pair of each short list whose sizes can link; those of one turn, as a names it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                names, low, high = (batch.column(k).slice(at, PIECE) for k in range(3))
                size = np.diff(names.offsets.to_numpy())
                names, low, high = (c.flatten().to_numpy() for c in (names, low, high))
                left = np.repeat(np.cumsum(size), size) - np.arange(len(names)) - 1
                left[(names.view(np.uint64) >> np.uint64(20)) % np.uint64(turns) != turn] = 0
                i = np.repeat(np.arange(len(names)), left)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(left) - left, left)
                able = (PERCENT * low[i] <= 100 * high[j]) & (PERCENT * low[j] <= 100 * high[i])
                i, j = i[able], j[able]
                need = 1 + (EXTRA * np.minimum(low[i], low[j])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.array(need)], names=["a", "b", "need"])

    return counted.where("not long").select("names", "low", "high").mapInArrow(run, "a long, b long, need int")


def _loose(signed: DataFrame) -> DataFrame:
    """Edges (a, b) between names of alike sets such that linked sets are connected.

    Linked sets share required() shingles of their prefixes. Those that are alike
    stand as one, with all shingles of their prefixes and their least and largest
    size in each list, so they share what any two of their sets do, and copies
    make no pairs. The pairs of each list of at most LIST names are counted, save
    those whose sizes are too far from each other to link: lists are written, and
    their pairs made and added up in turns, so that disk grows with the lists. A
    longer list, or that of a common shingle, only tells how many such each name
    has: a pair must share in short lists what is required less those (the T - L
    of DivideSkip). Only names whose long lists alone could do are tied, to the
    first of each such list.
    """
    need = lambda n: (1 + F.floor(F.lit(EXTRA) * F.col(n))).cast("int")
    p = signed.select("alike", F.posexplode("prefix").alias("at", "shingle"), "rare", "n")

    def listed(batches):
        held = [np.zeros(0, np.int64)] * 3

        def told(shingle, name, n):
            one = np.flatnonzero(np.append(True, (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])))[: len(shingle)]
            low, high = (f.reduceat(n, one) if len(n) else n for f in (np.minimum, np.maximum))
            shingle, name = shingle[one], name[one]
            start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))[: len(shingle)]
            size = np.diff(np.append(start, len(shingle)))
            many = np.repeat(size > 1, size)
            shingle, name, low, high = (x[many] for x in (shingle, name, low, high))
            size = size[size > 1]
            # a long list goes in pieces
            pieces = -(-size // PIECE)
            first = np.cumsum(pieces) - pieces
            cut = np.repeat(np.cumsum(size) - size, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(first, pieces))
            arrays = [pa.ListArray.from_arrays(pa.array(np.append(cut, len(name)).astype(np.int32)), pa.array(x)) for x in (name, low, high)]
            return pa.RecordBatch.from_arrays([pa.array(shingle[cut]), *arrays, pa.array(np.repeat(size > LIST, pieces))], names=["shingle", "names", "low", "high", "long"])

        for batch in batches:
            new = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            cut = np.searchsorted(new[0], new[0][-1]) if len(new[0]) else 0
            if cut:
                yield told(*(x[:cut] for x in new))
            held = [x[cut:] for x in new]
        yield told(*held)

    short = p.where(F.col("at") < F.col("rare")).select("shingle", "alike", "n")
    counted = written(short.repartition("shingle").sortWithinPartitions("shingle", "alike").mapInArrow(listed, "shingle long, names array<long>, low array<long>, high array<long>, long boolean"), "jaccard-counted")
    common = p.where(F.col("at") >= F.col("rare")).groupBy("alike", "shingle").agg(F.min(need("n")).alias("need"))
    long = counted.where("long").select("shingle", F.explode(F.arrays_zip("names", "low")).alias("one")).select(F.col("one.names").alias("alike"), "shingle", need("one.low").alias("need")).unionByName(common)
    heavy = written(long.groupBy("alike").agg(F.count("*").alias("lists"), F.min("need").alias("need")), "jaccard-heavy")
    of = lambda end: heavy.select(F.col("alike").alias(end), F.col("lists").alias(f"of_{end}"))
    fewer = F.least(F.coalesce("of_a", F.lit(0)), F.coalesce("of_b", F.lit(0)))
    made = counted.where("not long").agg(F.sum(F.size("names") * (F.size("names") - 1) / 2)).first()[0] or 0
    turns = max(1, ceil(made / max(PAIRS, PAIR_SHARE * (signed.agg(F.sum("n")).first()[0] or 0))))
    kept = []
    for turn in range(turns):
        pairs = written(_pairs(counted, turn, turns).groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")), "jaccard-pairs")
        kept.append(written(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.col("shared") >= F.col("need") - fewer).select("a", "b"), "jaccard-kept-pairs"))
        forget(pairs)
    # sizes of linked sets differ by a fifth at most, so the larger requirement by little more
    able = written(heavy.where(F.col("lists") >= 0.79 * F.col("need") - 1).select("alike"), "jaccard-able")
    tied = written(long.join(able, "alike").select("alike", "shingle"), "jaccard-tied")
    forget(counted, heavy, able)
    first = written(tied.groupBy("shingle").agg(F.min("alike").alias("b")), "jaccard-first")
    out = tied.join(first, "shingle").where("alike <> b").select(F.col("alike").alias("a"), "b")
    for pairs in kept:
        out = out.unionByName(pairs)
    out = written(out, "jaccard-loose")
    forget(tied, first, *kept)
    return out


class Groups:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.of(i), self.of(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def divide_skip(lists: list[np.ndarray], t: int) -> list[int]:
    """Numbers that are in at least t of the sorted lists.

    The longest lists are left for probing. The short ones are merged: by a heap
    that skips ahead past numbers which cannot reach t minus the number of long
    lists, or, where they hold much, by one sort. Survivors are looked up in the
    long lists by binary search.
    """
    if len(lists) < t:
        return []
    lists = sorted(lists, key=len)
    long = min(t - 1, int(t / (MU * log2(max(len(lists[-1]), 2)) + 1)))
    short, probed = lists[: len(lists) - long], lists[len(lists) - long :][::-1]
    need = t - long
    if sum(map(len, short)) > HEAP:
        found, n = np.unique(np.concatenate(short), return_counts=True)
        found, n = found[n >= need], n[n >= need]
    else:
        found, n = merge_skip([x.tolist() for x in short], need)
    for k, x in enumerate(probed):
        able = n + len(probed) - k >= t
        found, n = found[able], n[able]
        if not len(found):
            break
        at = np.minimum(np.searchsorted(x, found), len(x) - 1)
        n = n + (x[at] == found)
    return found[n >= t].tolist()


def merge_skip(lists: list[list[int]], need: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are in at least need of the sorted lists, and in how many, by a heap of the lists' heads."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        to = top + 1
        if len(popped) >= need:
            found.append(top)
            counts.append(len(popped))
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            to = max(heap[0][0], to)
        for _, i, at in popped:
            x = lists[i]
            at = bisect_left(x, to, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)


def search(sets: list[np.ndarray], side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets as all links would: each pair that links is connected by those returned.

    Sets are first compared with a few leaders that share their lowest
    shingles. Any link between the groups so found has an end outside the
    largest group, so those outside are searched for among all by T-occurrence.
    side: 0 or 1 for each set; then links within a side need not be returned.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    groups, links = Groups(len(sets)), []

    def link(i: int, j: int) -> None:
        groups.join(i, j)
        links.append((order[i], order[j]))

    leaders: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        low = s[:24].tolist()
        tried = Counter(j for x in low for j in leaders.get(x, ()))
        if not any(linked(sets[j], s) and (link(i, j) or True) for j, _ in tried.most_common(LEADERS)):
            for x in low:
                known = leaders.setdefault(x, [])
                if len(known) < LEADERS:
                    known.append(i)
    size = Counter(groups.of(i) for i in range(len(sets)))
    main = size.most_common(1)[0][0]
    queries = [i for i in range(len(sets)) if groups.of(i) != main]
    if queries:
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        every = np.concatenate(sets)
        by = np.lexsort((doc, every))
        every, doc = every[by], doc[by]
        edge = np.append(np.flatnonzero(np.append(True, every[1:] != every[:-1])), len(every))
        shared = np.flatnonzero(np.diff(edge) > 1)
        index = {k: doc[edge[j] : edge[j + 1]] for k, j in zip(every[edge[shared]].tolist(), shared)}
        for i in queries:
            if groups.of(i) == groups.of(main):
                continue  # what it links with outside the largest group finds it
            n = len(sets[i])
            for j in divide_skip([index[x] for x in sets[i].tolist() if x in index], -(-PERCENT * n // 100)):
                if groups.of(i) != groups.of(j) and (side is None or side[order[i]] != side[order[j]]) and linked(sets[i], sets[j]):
                    link(i, j)
    return links


def _links(docs: DataFrame, text: str, key: str, members: DataFrame, shingles: int) -> list[DataFrame]:
    """Written edges (a, b) between rows that link, from the members (row, key, told, n, root, parts) of loose groups.

    A group within GROUP_SHINGLES is one task's work. A larger one is split in
    parts by hash, and each pair of parts is searched by itself. As that takes a
    text as often as its group has parts, groups and pairs of parts are searched
    in as many rounds as keep what is shuffled at once near ROUND of all texts,
    which have so many shingles.
    """
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    dealt_out = members.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    rounds = max(1, ceil(dealt_out / max(GROUP_SHINGLES, ROUND * shingles)))

    def run(batches):
        shingle, now, rows = Shingler(), None, {}

        def closed():
            ids = list(rows)
            sets = shingle([rows[r][0] for r in ids])
            found = search(sets, [rows[r][1] for r in ids] if now[1] != now[2] else None) if len(ids) > 1 else []
            a, b = ([ids[p[x]] for p in found] for x in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for root, i, j, row, own, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != now:
                    if now:
                        yield closed()
                    now, rows = (root, i, j), {}
                rows.setdefault(row, (x, own))
        if now:
            yield closed()

    out = []
    for turn in range(rounds):
        of_turn = lambda c: F.pmod(F.xxhash64("root", c["i"], c["j"]), F.lit(rounds)) == turn  # noqa: E731, B023
        chosen = members.withColumn("part", part).withColumn("pairs", F.filter(pairs, of_turn)).where(F.size("pairs") > 0)
        some = maybe_among(docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text")), F.xxhash64("k", "t"), chosen.select(F.xxhash64("key", "told").alias("kt"))).where("__hit")
        sets = some.join(chosen.hint("merge"), F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("told"))).select("root", "row", "part", "pairs", "text")
        dealt = sets.withColumn("pair", F.explode("pairs")).select("root", "pair.i", "pair.j", "row", "part", "text")
        grouped = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "row")
        out.append(written(grouped.mapInArrow(run, "a long, b long"), "jaccard-links"))
    return out


def _placed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: facts (row, key, told, n, high, low) of all documents, and classes of equal sets (high, low, n, first, least, root).

    first is the class's document with the least key, null keys last. All other
    tables are deleted again.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, text))
    signed = _signed(docs, key, text, common)
    tied = _loose(signed)
    loose = components(tied)
    forget(tied)
    facts = written(signed.select("row", "key", "told", "n", "high", "low", "alike"), "jaccard-facts")
    forget(signed)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "told", "row")).alias("first")
    classes = written(facts.where("n > 0").groupBy("high", "low", "n").agg(first, F.min("key").alias("least"), F.min("alike").alias("alike")), "jaccard-classes")
    able = classes.join(loose, F.col("alike") == F.col("node"), "left").select("first.row", "first.key", "first.told", "n", F.coalesce("root", "alike").alias("root"))
    size = able.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    members = written(able.join(size, "root").select("row", "key", "told", "n", "root", F.ceil(F.col("shingles") / GROUP_SHINGLES).cast("int").alias("parts")), "jaccard-members")
    edges = _links(docs, text, key, members, facts.agg(F.sum("n")).first()[0] or 0)
    links = components(reduce(DataFrame.unionByName, edges))
    placed = written(classes.join(links, F.col("first.row") == F.col("node"), "left").select("high", "low", "n", "first", "least", F.coalesce("root", "first.row").alias("root")), "jaccard-placed")
    forget(loose, classes, members, *edges, links)
    return facts, placed


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents that are connected by links: (key, n_shingles, component_id).

    Equal sets are one class. Classes whose prefixes share enough form loose
    groups, and only documents of loose groups are searched with their whole
    sets. The links found there give the groups; component_id is the least key
    in each.

    Texts without words have no shingles and link with nothing, with fewer than
    five words the whole sequence is the one shingle. Keys may repeat or be null
    (the least key of a group is then the least that is not null). Rows: as many
    as documents. docs is read several times and must give the same rows each
    time, which tables in files do.
    """
    facts, placed = _placed(docs, key, text)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(placed.join(least, "root").select(F.col("high").alias("h"), F.col("low").alias("l"), "component_id"), "jaccard-named")
    forget(placed)
    out = facts.join(named, (F.col("high") == F.col("h")) & (F.col("low") == F.col("l")) & (F.col("n") > 0), "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group: that with the least key, null keys last; documents without words all stay.

    What goes is told by key and text. Rows whose key and text are surely not
    among those pass as they are, and rows that are surely not among what stays
    are dropped; only the others are shuffled, to a join that tells. Of rows
    equal in both, one stays where their group's document is one of them. All
    columns stay, whatever their names.
    """
    facts, placed = _placed(docs, key, text)
    kept = placed.groupBy("root").agg(F.min("first").alias("first")).select("first.row", "first.key", "first.told")
    kept = written(kept, "jaccard-kept")
    gone = facts.where("n > 0").join(kept.select("row"), "row", "left_anti").select("key", "told").distinct()
    stays = kept.select(F.col("key").alias("k"), F.col("told").alias("t"), F.lit(True).alias("one"))
    odd = written(gone.join(stays, F.col("key").eqNullSafe(F.col("k")) & (F.col("told") == F.col("t")), "left").select(F.col("key").alias("odd_key"), F.col("told").alias("odd_told"), F.coalesce("one", F.lit(False)).alias("one")), "jaccard-odd")
    staying = kept.select("key", "told").unionByName(facts.where("n = 0").select("key", "told"))
    staying = written(staying.select(F.xxhash64("key", "told").alias("name")), "jaccard-staying")
    forget(facts, placed, kept)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    of = lambda name: F.col(f"c{docs.columns.index(name)}")
    name = F.xxhash64(of(key), "told")
    told = maybe_among(rows.withColumn("told", F.xxhash64(of(text))), name, odd.select(F.xxhash64("odd_key", "odd_told").alias("name")))
    same = of(key).eqNullSafe(F.col("odd_key")) & (F.col("told") == F.col("odd_told"))
    met = maybe_among(told.where("__hit").drop("__hit"), name, staying).where("__hit").join(odd, same, "left")
    nth = F.row_number().over(Window.partitionBy("odd_key", "odd_told").orderBy("odd_told"))
    one = met.where("one").withColumn("nth", nth).where("nth = 1")
    columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return told.where("not __hit").select(*columns).unionByName(met.where("one is null").select(*columns)).unionByName(one.select(*columns))
