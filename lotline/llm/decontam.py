"""Benchmark decontamination with suffix arrays over shards of the training documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Words in a window.
WINDOW = 10
#: Words of training text that one suffix array covers (a longer document has its own).
SHARD_WORDS = 1_000_000
#: Characters of benchmark text in one block; more are searched block after block.
BLOCK_CHARS = 16_000_000

#: Bytes to words: A-Z lower-cased, ASCII other than letters and digits to blanks, all else kept.
_TABLE = bytes(b if b >= 128 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Tests:
    """The test items of one block: their words as numbers, and their windows, each distinct one once.

    at: (window, item, position) of every window of every item. The items of a
    window are kept as the number of their set, so a passage that many items have
    is one entry for all its windows.
    """

    def __init__(self, items: list[tuple[list[str], str]]):
        self.number: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        rows: dict[tuple[int, ...], int] = {}
        at: list[tuple[int, int, int]] = []
        owners: list[list[int]] = []
        for names, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if not seq:
                continue
            for j in range(max(1, len(seq) - WINDOW + 1)):
                k = rows.setdefault(tuple(seq[j : j + WINDOW]), len(owners))
                if k == len(owners):
                    owners.append([])
                if owners[k][-1:] != [len(self.ids)]:
                    owners[k].append(len(self.ids))
                at.append((k, len(self.ids), j))
            self.ids.append(names)
        self.length = np.array([len(r) for r in rows], dtype=np.int64)
        low = np.zeros((len(rows), WINDOW), dtype=">u4")
        high = np.full((len(rows), WINDOW), 0xFFFFFFFF, dtype=">u4")
        for k, r in enumerate(rows):
            low[k, : len(r)] = high[k, : len(r)] = r
        self.low, self.high = (_keys(x) for x in (low, high))
        self.at = np.array(at, dtype=np.int64).reshape(-1, 3)
        sets: dict[tuple[int, ...], int] = {}
        self.owners = np.array([sets.setdefault(tuple(x), len(sets)) for x in owners], dtype=np.int64)
        self.sets = [sorted({name for i in x for name in self.ids[i]}) for x in sets]
        self.least = int(self.length.min()) if len(rows) else 0


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{4 * WINDOW}").ravel()


def suffix_array(seq: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the suffixes of seq, and where each starts.

    seq holds 0 for words that are in no test item and between documents. A
    suffix whose first `least` words include one cannot match and is left out;
    the others are ordered by their first WINDOW words.
    """
    zero = np.flatnonzero(seq == 0)
    run = np.append(zero, len(seq))[np.searchsorted(zero, np.arange(len(seq)))] - np.arange(len(seq))
    start = np.flatnonzero(run >= max(least, 1))
    padded = np.concatenate([seq, np.zeros(WINDOW, dtype=seq.dtype)]).astype(">u4")
    keys = _keys(padded[start[:, None] + np.arange(WINDOW)]) if len(start) else np.array([], dtype=f"S{4 * WINDOW}")
    order = np.argsort(keys, kind="stable")
    return keys[order], start[order]


def search(seq: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of each place of seq where a window of the tests occurs, by binary search."""
    keys, start = suffix_array(seq, tests.least)
    lo, hi = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    hi = np.where(tests.length == WINDOW, np.searchsorted(keys, tests.low, "right"), hi)
    n = hi - lo
    window = np.repeat(np.arange(len(n)), n)
    return start[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], window


def doubled(letter: np.ndarray, after: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Ranks, steps and lengths of all suffixes of chains of letters, by prefix doubling.

    after: the next place of each, -1 at an end. Level k orders suffixes by their
    first 2^k letters, from the ranks of both halves; step is the place 2^k on
    and length how many letters there are up to it.
    """
    ranks, steps, lengths = [np.unique(letter, return_inverse=True)[1] + 1], [after], [np.ones(len(letter), dtype=np.int64)]
    while (steps[-1] >= 0).any():
        rank, step, length = ranks[-1], steps[-1], lengths[-1]
        on = step >= 0
        second = np.where(on, rank[step], 0)
        ranks.append(np.unique(rank * (len(letter) + 2) + second, return_inverse=True)[1] + 1)
        lengths.append(length + np.where(on, length[step], 0))
        steps.append(np.where(on, step[step], -1))
    return ranks, steps, lengths


def common_prefix(a: np.ndarray, b: np.ndarray, levels) -> np.ndarray:
    """Letters that the suffixes at places a and b have in common (-1: no place), from the largest level down."""
    out, a, b = np.zeros(len(a), dtype=np.int64), a.copy(), b.copy()
    for rank, step, length in zip(*(x[::-1] for x in levels)):
        same = (a >= 0) & (b >= 0)
        same[same] = rank[a[same]] == rank[b[same]]
        out[same] += length[a[same]]
        a[same], b[same] = step[a[same]], step[b[same]]
    return out


def longest(start: np.ndarray, window: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct matching start: the words of its longest match with any test suffix, that one's item and position.

    Training and test suffixes that match at all are put in one suffix array, by
    prefix doubling over their windows as letters; the longest match of a
    training suffix is the longer common prefix with its two neighbours among
    the test suffixes. Of equal test suffixes the first stands for all, so only
    as many rows are made as there are matching places.
    """
    size = tests.length[window]
    by = np.lexsort((-size, start))
    first = by[np.flatnonzero(np.diff(start[by], prepend=-1))]  # the longest window that starts at each place
    place, letter = start[first], window[first]
    found = np.zeros(len(tests.length), dtype=bool)
    found[window] = True
    rows = tests.at[found[tests.at[:, 0]]]
    n, m = len(place), len(rows)
    follows = np.full(n + m, -1)
    follows[: n - 1] = np.where((np.diff(place) == 1) & (tests.length[letter[1:]] == WINDOW) & (tests.length[letter[:-1]] == WINDOW), np.arange(1, n), -1)
    if m > 1:
        follows[n : n + m - 1] = np.where((np.diff(rows[:, 1]) == 0) & (np.diff(rows[:, 2]) == 1), np.arange(n + 1, n + m), -1)
    levels = doubled(np.concatenate([letter, rows[:, 0]]), follows)
    order = np.argsort(levels[0][-1], kind="stable")
    is_test = order >= n
    count = np.cumsum(is_test)
    hit = np.flatnonzero(~is_test)
    of_tests, own = order[is_test], order[hit]
    # training places come before test ones of equal rank
    before, behind = count[hit] - 1, count[hit]
    ends = [np.where((x >= 0) & (x < m), of_tests[np.clip(x, 0, m - 1)], -1) for x in (before, behind)]
    both = [common_prefix(own, x, levels) for x in ends]
    second = both[1] >= both[0]
    best, other = np.where(second, both[1], both[0]), np.where(second, ends[1], ends[0])
    words = np.zeros(n, dtype=np.int64)
    words[own] = tests.length[letter[own]] + best - 1
    told = np.zeros((n, 2), dtype=np.int64)
    told[own] = rows[other - n, 1:]
    return place, words, told


def _shard(docs: list[np.ndarray], tests: Tests) -> list[tuple[np.ndarray, list[str], tuple[int, str | None, int, int]]]:
    """For each document of a shard: hit words, item ids, and its longest match (length, item, word, position)."""
    offset = np.cumsum([0, *(len(d) + 1 for d in docs)])
    seq = np.zeros(offset[-1], dtype=np.uint32)
    for d, o in zip(docs, offset):
        seq[o : o + len(d)] = d
    start, window = search(seq, tests) if tests.least else (np.zeros(0, np.int64),) * 2
    if not len(start):
        return [(np.zeros(len(d), dtype=bool), [], (0, None, -1, -1)) for d in docs]
    mark = np.zeros(len(seq) + 1, dtype=np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + tests.length[window], -1)
    hit = np.cumsum(mark)[:-1] > 0
    sets = np.unique(np.stack([np.searchsorted(offset, start, "right") - 1, tests.owners[window]]), axis=1)
    place, size, told = longest(start, window, tests)
    doc = np.searchsorted(offset, place, "right") - 1
    order = np.lexsort((place, -size, doc))
    best = dict(zip(*(x[::-1].tolist() for x in (doc[order], order))))  # of each document the first
    edge = np.searchsorted(sets[0], np.arange(len(docs) + 1))
    out = []
    for k in range(len(docs)):
        ids = sorted({name for x in sets[1, edge[k] : edge[k + 1]] for name in tests.sets[x]})
        b = best.get(k)
        most = (0, None, -1, -1) if b is None else (int(size[b]), min(tests.ids[told[b, 0]], default=None), int(place[b] - offset[k]), int(told[b, 1]))
        out.append((hit[offset[k] : offset[k + 1] - 1], ids, most))
    return out


RESULT = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean, items: array<string>, longest: bigint, longest_item: string, longest_at: bigint, longest_from: bigint, hit: binary>"


def annotated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", result: str = "decontamination") -> DataFrame:
    """All columns of docs and a struct that says what of the benchmark they contain.

    Each task numbers the words of its documents by the test words, builds a
    suffix array over a shard of bounded size, ordered by the WINDOW words that a
    match needs, and binary-searches every test suffix in it. The suffixes that
    match are put in full order together with the tests' by prefix doubling, and
    common prefixes of neighbours give the longest matches and where they are. No
    documents are shuffled. The benchmark goes to the tasks in blocks of
    BLOCK_CHARS characters; where it has more, the documents are written after
    each block with the words hit so far, so one block is held at a time.

    Null texts have no words. Items of equal text are one with several ids; an
    item without id is searched too but not counted among the items. Repeated
    rows give equal results. result must not be a column of docs.
    """
    if result in docs.columns:
        raise ValueError(f"{result} is a column of the documents")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    grouped = items.groupBy("text").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    out = docs
    for b in range(blocks):
        rows = grouped.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text").collect()
        tests = spark.sparkContext.broadcast(Tests([(r["ids"], r["text"]) for r in rows]))
        before, out = out, out.mapInArrow(_step(tests, text, result, bool(b)), _schema(docs, result))
        if b < blocks - 1:
            out = written(out, "decontam-block")
            tests.destroy()
            if b:
                forget(before)
    return out


def _schema(docs: DataFrame, result: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*docs.schema.fields]).add(result, _parse_datatype_string(RESULT))


def _step(shared, text: str, result: str, later: bool):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(RESULT))

    def run(batches):
        tests = shared.value
        number = tests.number
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(text)).to_pylist()
            before = batch.column(names.index(result)).to_pylist() if later else [None] * len(texts)
            rows, docs, size = [], [], 0
            for x in texts:
                seq = np.array([number.get(w, 0) for w in words(x)], dtype=np.uint32)
                docs.append(seq)
                size += len(seq)
                if size >= SHARD_WORDS:
                    rows += _shard(docs, tests)
                    docs, size = [], 0
            rows += _shard(docs, tests) if docs else []
            said = []
            for (hit, ids, best), was in zip(rows, before):
                if was:
                    hit = hit | np.unpackbits(np.frombuffer(was["hit"], np.uint8), count=len(hit)).astype(bool)
                    ids = sorted({*ids, *was["items"]})
                    best = max(best, (was["longest"], was["longest_item"], was["longest_at"], was["longest_from"]), key=lambda m: m[0])
                said.append({"n_words": len(hit), "n_hit": int(hit.sum()), "n_items": len(ids), "items_sha256": hashlib.sha256(",".join(ids).encode()).hexdigest(), "contaminated": bool(hit.any()), "items": ids, "longest": best[0], "longest_item": best[1], "longest_at": best[2], "longest_from": best[3], "hit": np.packbits(hit).tobytes()})
            keep = [c for n, c in zip(names, batch.columns) if n != result]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(said, type=kind)], names=[*(n for n in names if n != result), result])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that contain no window of the benchmark."""
    return annotated(docs, benchmark, text).where("not decontamination.contaminated").drop("decontamination")
