"""Repeated passages, from suffix arrays and Burrows-Wheeler transforms of shards that are merged by refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, maybe_among, written
from .decontam import common_prefix

#: Bytes of a passage that must not occur twice.
LENGTH = 400
#: Bytes of text in one shard (a longer document has its own).
SHARD_BYTES = 2_000_000
#: Documents in one shard, and shards of one partition, at most.
SHARD_DOCS, PART_SHARDS = 1 << 20, 1 << 20


def _spread(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to evenly spread ones, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Polynomial digests (modulo 2^64) of all slices of a sequence."""

    BASE = 0x9E3779B97F4A7C15
    _power = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        if len(Sums._power) < n:
            for name, base in (("_power", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n + n // 4, base, dtype=np.uint64)
                steps[0] = 1
                setattr(Sums, name, np.cumprod(steps))
        self.upto = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * Sums._power[: n - 1], out=self.upto[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _spread((self.upto[end] - self.upto[begin]) * Sums._inverse[begin] + (end - begin).astype(np.uint64))


_LETTERS = _spread(np.arange(1, 257, dtype=np.uint64) * np.uint64(Sums.BASE))


def bytes_sums(text: np.ndarray) -> Sums:
    return Sums(_LETTERS[text])


def _slide(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) of every width neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = best(x[:-done], x[done:]), 2 * done
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


class Cut:
    """How texts are cut into phrases so that equal passages are cut alike.

    A byte begins a phrase if the digest of the gram that begins there is the
    least in some window of `width` neighbouring grams (all of them where several
    are least). So a phrase has at most width bytes, and whether a byte begins
    one depends on the bytes from left before to width + gram after it. Of a
    passage of `length` bytes, the phrases from the first that begins `left`
    bytes in up to `inner` bytes on are therefore cut alike wherever it stands.
    """

    def __init__(self, length: int):
        if length < 40:
            raise ValueError("passages must have 40 bytes at least")
        self.length, self.width, self.gram = length, length // 5, length // 33
        self.left = self.width - 1
        #: the first phrase begins within 2 * width - 2 bytes; what follows must end before width + gram bytes from the end
        self.inner = length - 4 * self.width + 4 - self.gram
        #: all passages of a phrase hold the bytes from left before it to right behind
        self.right = length - 2 * self.width + 2

    def begins(self, text: np.ndarray, starts: np.ndarray, sums: Sums) -> np.ndarray:
        """Where phrases begin in concatenated texts, with all starts of texts and the end of the last."""
        n, w = len(text), self.width
        grams = np.full(n + w - 1, 0xFFFFFFFF, dtype=np.uint32)
        at = np.arange(max(0, n - self.gram + 1))
        grams[: len(at)] = sums.of(at, at + self.gram) >> np.uint64(32)
        least = np.zeros(n + w - 1, dtype=np.uint32)
        least[w - 1 :] = _slide(np.minimum, grams, w)
        chosen = np.append(grams[:n] == _slide(np.maximum, least, w), True)
        chosen[starts] = True
        return np.flatnonzero(chosen)


def suffixes(letter: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes by their first letters (at least depth of them), and how many letters each shares with the one before.

    left: the letters from each up to the end of its document, where a suffix ends.
    """
    n = len(letter)
    here = np.arange(n)
    rank = np.unique(letter, return_inverse=True)[1] + 1
    levels, size = [], 1
    while True:
        step = np.where(left > size, here + size, -1)
        levels.append((rank, step, np.minimum(left, size)))
        if size >= depth or rank.max(initial=0) == n:
            break
        second = np.where(step >= 0, rank[step], 0)
        rank, size = np.unique(rank * (n + 2) + second, return_inverse=True)[1] + 1, 2 * size
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int64)
    common[1:] = common_prefix(order[1:], order[:-1], tuple(zip(*levels)))
    return order, common


class Shard:
    """The phrases of some documents (begins: where they begin, and the end), their names and the order of their suffixes.

    documents: the first phrase of each, and the number of phrases. order and
    common: the suffixes in order, and how many phrases each shares with the one
    before; the Burrows-Wheeler transform is what precedes them, names[order - 1].
    cores: for each anchor the name of the bytes that all its passages hold.
    """

    COLUMNS = {"documents": np.int32, "begins": np.int32, "names": np.uint64, "order": np.int32, "common": np.int16, "cores": np.uint64}

    def __init__(self, cut: Cut, **columns):
        self.cut = cut
        for n in self.COLUMNS:
            setattr(self, n, columns[n])
        first = np.repeat(np.arange(len(self.documents) - 1), np.diff(self.documents))
        self.document = first
        self.begin = self.begins[self.documents[first]].astype(np.int64)
        self.end = self.begins[self.documents[first + 1]].astype(np.int64)
        self.sums = Sums(self.names)

    @classmethod
    def built(cls, cut: Cut, text: np.ndarray, starts: np.ndarray) -> Shard:
        sums = bytes_sums(text)
        begins = cut.begins(text, starts, sums)
        names = sums.of(begins[:-1], begins[1:])
        documents = np.searchsorted(begins, np.append(starts, len(text)))
        shard = cls(cut, documents=documents, begins=begins, names=names, order=None, common=None, cores=np.zeros_like(names))
        last = documents[shard.document + 1]
        at = shard.anchors()
        depth = max((shard.outer(at)[1] - shard.outer(at)[0]).max(initial=1), (shard.reach(at) - at).max(initial=1))
        shard.order, shard.common = suffixes(names, last - np.arange(len(names)), int(depth))
        shard.common = np.minimum(shard.common, np.iinfo(np.int16).max)
        shard.cores[at] = sums.of(begins[at] - cut.left, begins[at] + cut.right)
        return shard

    def stored(self) -> list[bytes]:
        return [(np.diff(self.begins, prepend=0) if n == "begins" else getattr(self, n)).astype(t).tobytes() for n, t in self.COLUMNS.items()]

    @classmethod
    def read(cls, cut: Cut, parts: list[bytes]) -> Shard:
        columns = {n: np.frombuffer(p, dtype=t) for (n, t), p in zip(cls.COLUMNS.items(), parts)}
        columns |= {n: columns[n].astype(np.int64) for n in ("documents", "order", "common")} | {"begins": np.cumsum(columns["begins"], dtype=np.int64)}
        return cls(cut, **columns)

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last start of those passages whose first phrase, `left` bytes in or later, is at."""
        low = np.maximum(self.begins[at - 1] - self.cut.left + 1, self.begin[at])
        return low, np.minimum(self.begins[at] - self.cut.left, self.end[at] - self.cut.length)

    def anchors(self) -> np.ndarray:
        """The phrases that are the first of any passage."""
        at = np.arange(len(self.names))
        at = at[self.begins[:-1] != self.begin]
        low, high = self.windows(at)
        return at[low <= high]

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Up to which phrase the shortest run of phrases with `inner` bytes goes (or to the document's end)."""
        return np.minimum(np.searchsorted(self.begins, self.begins[at] + self.cut.inner), self.documents[self.document[at] + 1])

    def outer(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The run of phrases that covers all passages of an anchor: steps to the left, then to the right."""
        low, high = self.windows(at)
        return np.searchsorted(self.begins, low, "right") - 1, np.searchsorted(self.begins, high + self.cut.length)

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all anchors in the order of suffixes: the anchor, its block, and the name of that.

        A block are the suffixes that share the inner run. As they are sorted,
        a block is an interval: one begins where a suffix shares less than its
        inner run with the one before.
        """
        size = self.reach(np.arange(len(self.names))) - np.arange(len(self.names))
        is_anchor = np.zeros(len(self.names), dtype=bool)
        is_anchor[self.anchors()] = True
        number = np.cumsum(self.common < size[self.order])
        keep = is_anchor[self.order]
        at = self.order[keep]
        return at, number[keep], self.sums.of(at, at + size[at]).view(np.int64)


def _shards(cut: Cut):
    """mapInArrow: documents (digest, body) to shards, a row each."""
    from pyspark import TaskContext

    def run(batches):
        number = TaskContext.get().partitionId() * PART_SHARDS
        for batch in batches:
            digest, body = batch.column(0), batch.column(1)
            ends = np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
            text = np.frombuffer(body.buffers()[2] or b"", dtype=np.uint8)
            i = 0
            while i < len(body):
                j = min(max(i + 1, int(np.searchsorted(ends, ends[i] + SHARD_BYTES, "right")) - 1), i + SHARD_DOCS, len(body))
                shard = Shard.built(cut, text[ends[i] : ends[j]], ends[i:j] - ends[i])
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([digest.slice(i, j - i).to_pylist()], type=pa.list_(pa.binary())), *(pa.array([x], type=pa.binary()) for x in shard.stored())], names=["shard", "digests", *Shard.COLUMNS])
                i, number = j, number + 1

    return run


def _stored(cut: Cut, batches) -> Iterator[tuple[int, Shard]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("shard")[i].as_py(), Shard.read(cut, [batch.column(n)[i].as_py() for n in Shard.COLUMNS])


def _interleave(cut: Cut):
    """mapInArrow: shards to (block, n): how many suffixes of a shard a block has."""

    def run(batches):
        for _, shard in _stored(cut, batches):
            _, number, block = shard.blocks()
            first = np.flatnonzero(np.diff(number, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(np.diff(np.append(first, len(number))))], names=["block", "n"])

    return run


PLACES = "block long, core long, around long, document long, low long, n int"


def _refined(cut: Cut):
    """mapInArrow: shards to their anchors in the order of suffixes: PLACES.

    core names the bytes that all passages of the anchor hold, around the outer
    run of phrases and which of its bytes begin passages: anchors that share it
    share all of those passages.
    """

    def run(batches):
        for name, shard in _stored(cut, batches):
            at, _, block = shard.blocks()
            low, high = shard.windows(at)
            begin, end = shard.outer(at)
            around = shard.sums.of(begin, end) + _spread((low - shard.begins[begin]).astype(np.uint64) * np.uint64(1 << 32) + (high - low).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block), pa.array(shard.cores[at].view(np.int64)), pa.array(around.view(np.int64)), pa.array(name * SHARD_DOCS + shard.document[at]), pa.array(low - shard.begin[at]), pa.array(high - low + 1, type=pa.int32())],
                names=["block", "core", "around", "document", "low", "n"],
            )

    return run


def _passages(cut: Cut):
    """mapInArrow: texts with anchors to (core, passage, document, low, copies), a row for each passage of those."""

    def run(batches):
        for batch in batches:
            out = []
            for body, asked in zip(batch.column("body"), batch.column("asked")):
                text = np.frombuffer(body.as_buffer(), dtype=np.uint8)
                sums = bytes_sums(text)
                asked = asked.values
                core, document, low, n, copies = (asked.field(x).to_numpy() for x in ("core", "document", "low", "n", "copies"))
                which = np.repeat(np.arange(len(n)), n)
                at = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                out.append((core[which], sums.of(at, at + cut.length).view(np.int64), document[which], at, copies[which]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["core", "passage", "document", "low", "copies"])

    return run


def _spans(cut: Cut):
    """mapInArrow: (digest, [(low, n)]) to (digest, spans): the stretches that the passages cover."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            spans = []
            for r in batch.column("found"):
                low, n = (r.values.field(x).to_numpy() for x in ("low", "n"))
                order = np.argsort(low, kind="stable")
                low, end = low[order], np.maximum.accumulate((low + n - 1 + cut.length)[order])
                new = np.flatnonzero(np.append(True, low[1:] > end[:-1]))
                spans.append([{"begin": int(b), "end": int(e)} for b, e in zip(low[new], end[np.append(new[1:] - 1, len(low) - 1)])])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(spans, type=kind)], names=["digest", "spans"])

    return run


def _digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(digest, spans) of texts that repeat passages, and (digest) of texts that more than one row of docs has.

    1. Texts are cut into phrases by their content. Each shard, a bounded number
       of bytes of one task, sorts the suffixes of its phrases: its transform.
    2. The transforms are merged without sorting suffixes again. The interleave
       tells, for each block (suffixes that share a prefix), how many each shard
       has, and is refined. The first prefix is the inner run, phrases that any
       two equal passages share; blocks of one suffix drop out, by a filter of
       bounded size, which may let some through. The others are split by their
       core, to the left along the transform and to the right, and then by the
       outer run that reaches over all passages of a phrase. Where that one
       occurs twice, all those passages are repeated. Blocks are added up by
       name, so it doesn't matter how many suffixes one has.
    3. At the edges of a repeated stretch, a core occurs in several outer runs.
       There the passages themselves are compared, a row for each start, one
       suffix for each outer run. So edges are exact to the byte.

    Names are digests of 64 bits of phrases that are named likewise; passages
    are compared by core and digest together.
    """
    cut = Cut(length)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    own = docs.select(_digest(body).alias("digest"), body.alias("body"))
    shards = written(own.mapInArrow(_shards(cut), "shard long, digests array<binary>, " + ", ".join(f"{n} binary" for n in Shard.COLUMNS)), "bwt")
    names = written(shards.select((F.col("shard") * SHARD_DOCS).alias("of"), F.posexplode("digests").alias("i", "digest")).select((F.col("of") + F.col("i")).alias("document"), "digest"), "bwt-names")
    held = written(names.groupBy("digest").agg(F.count("*").alias("rows"), F.min("document").alias("document")), "bwt-held")
    copies = held.where("rows > 1").select("digest")

    # the interleave after the inner run
    parts = shards.drop("digests")
    several = written(parts.mapInArrow(_interleave(cut), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).where("n > 1").select("block"), "bwt-several")
    places = written(maybe_among(parts.mapInArrow(_refined(cut), PLACES), F.col("block"), several).where("__hit").select("core", "around", "document", "low", "n"), "bwt-places")
    forget(several, shards)

    # after the core and the outer run
    outer = written(places.groupBy("core", "around").agg(F.count("*").alias("copies"), F.min(F.struct("document", "low", "n")).alias("one")), "bwt-outer")
    edges = written(outer.groupBy("core").agg(F.count("*").alias("runs"), F.min("copies").alias("least")).where("runs > 1 and least = 1").select("core"), "bwt-edges")
    whole = written(outer.where("copies > 1").select("core", "around"), "bwt-whole")
    covered = places.join(whole, ["core", "around"]).select("document", "low", "n")

    # at the edges, passage by passage
    asked = maybe_among(outer, F.col("core"), edges).where("__hit").join(edges, "core").select("core", "one.*", F.least("copies", F.lit(2)).cast("int").alias("copies"))
    asked = written(asked.join(names, "document").groupBy("digest").agg(F.collect_list(F.struct("core", "document", "low", "n", "copies")).alias("asked")), "bwt-asked")
    texts = maybe_among(own, F.col("digest"), asked.select("digest")).where("__hit").groupBy("digest").agg(F.first("body").alias("body"))
    passages = written(texts.join(asked, "digest").mapInArrow(_passages(cut), "core long, passage long, document long, low long, copies int"), "bwt-passages")
    shared = written(passages.groupBy("core", "passage").agg(F.sum("copies").alias("n")).where("n > 1").select("core", "passage"), "bwt-shared")
    found = covered.unionByName(passages.where("copies = 1").join(shared, ["core", "passage"]).select("document", "low", F.lit(1).alias("n")))

    # texts of several rows are repeated whole
    only = held.where("rows = 1").select("document", "digest")
    spans = written(found.join(only, "document").groupBy("digest").agg(F.collect_list(F.struct("low", "n")).alias("found")).mapInArrow(_spans(cut), "digest binary, spans array<struct<begin: bigint, end: bigint>>"), "bwt-spans")
    told = written(copies, "bwt-copies")
    forget(names, held, places, outer, edges, whole, asked, passages, shared)
    return spans, told


def annotated(docs: DataFrame, text: str = "text", length: int = LENGTH, result: str = "repeats") -> DataFrame:
    """All columns of docs and a struct result: n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte is removed if a string of `length` bytes that covers it begins at any
    other place too, in the same document or another. spans are the maximal
    removed stretches (begin, end in bytes), kept what is left (null where nothing
    is removed, as it is the text then). Cuts are judged on bytes, so kept may
    begin or end within a character.

    Null texts are empty; shorter texts than length keep all. A row whose text
    another row has too loses all of it, if it is long enough. result must not be
    a column of docs. No rows give no rows.
    """
    if result in docs.columns:
        raise ValueError(f"{result} is a column of the documents")
    spans, copies = repeated(docs, text, length)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    size = F.octet_length(body).cast("long")
    no_span = F.array().cast("array<struct<begin: bigint, end: bigint>>")

    def told(removed: Column, sha: Column, stretches: Column, kept: Column) -> Column:
        return F.struct(size.alias("n_bytes"), removed.cast("long").alias("n_removed"), F.size(stretches).cast("long").alias("n_spans"), sha.alias("kept_sha256"), stretches.alias("spans"), kept.cast("binary").alias("kept"))

    marked = maybe_among(docs.withColumn("__digest", _digest(body)), F.col("__digest"), spans.select("digest"))
    hit = marked.where("__hit").join(spans.select(F.col("digest").alias("__digest"), F.col("spans").alias("__spans")), "__digest", "left")
    cut = F.coalesce("__spans", no_span)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["end"]))
    begins = F.concat(F.transform(cut, lambda s: s["begin"]), F.array(size))
    pieces = F.zip_with(ends, begins, lambda b, e: F.hex(F.substring(body, b.cast("int") + 1, (e - b).cast("int"))))
    kept = F.when(F.col("__spans").isNotNull(), F.unhex(F.array_join(pieces, "")))
    removed = F.aggregate(cut, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    some = hit.withColumn("__kept", kept).select(*columns, "__digest", told(removed, F.sha2(F.coalesce("__kept", body), 256), cut, F.col("__kept")).alias(result))
    none = marked.where("not __hit").select(*columns, "__digest", told(F.lit(0), F.lower(F.hex("__digest")), no_span, F.lit(None)).alias(result))
    rows = some.unionByName(none).join(copies.select(F.col("digest").alias("__digest"), F.lit(True).alias("__copy")), "__digest", "left")
    r = F.col(f"`{result}`")
    n = r["n_bytes"]
    all_of_it = F.struct(n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.array(F.struct(F.lit(0).cast("long").alias("begin"), n.alias("end"))).alias("spans"), F.lit(b"").alias("kept"))
    return rows.select(*columns, F.when(F.col("__copy") & (n >= length), all_of_it).otherwise(r).alias(result))


def clean(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """docs without repeated passages: text holds what is left (bytes that are no whole character become U+FFFD)."""
    left = F.col("__repeats.kept")
    out = annotated(docs, text, length, "__repeats")
    return out.select(*(F.when(left.isNotNull(), F.decode(left, "UTF-8")).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
