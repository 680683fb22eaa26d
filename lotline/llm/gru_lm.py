"""A gated recurrent language model that scores whole documents."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written

#: Words whose counts the tasks hold, none with more bytes than HOT_BYTES; the others' counts are joined.
HOT, HOT_BYTES = 200_000, 64
#: Words of the recurrent model (the end among them), its classes of words, its units.
WORDS, CLASSES, UNITS = 2048, 48, 16
#: Words in a segment; words that a gradient goes back; segments learned from at once, at first and at most.
SEGMENT, BACK, FIRST, BATCH = 128, 32, 16, 256
#: Times that the trainers' models are averaged (each segment is learned from in one of them), their learning rate, the training words to a trainer, and the models that one task averages.
ROUNDS, STEP, PER_TRAINER, MEAN = 2, 0.01, 30_000_000, 64
#: Documents and words that are scored side by side, and bytes of text that are split at once.
SIDE, WINDOW, HELD_BYTES = 2048, 64, 16 << 20

END = b""


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased, then the end."""
    return [*(text or b"").lower().split(), END]


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (strings), as tokens() tells them but without the ends, and the text that each is of."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, of = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    return words.filter(real).cast(pa.binary()), of.filter(real).to_numpy()


class Shape:
    """The model's words (the first of counts, by falling count) in classes: frequent words in small classes, and a last class for all others."""

    def __init__(self, counts: list[tuple[bytes, int]], total: int, types: int):
        ordered = counts[:WORDS]
        if all(w != END for w, _ in ordered):
            ordered = [*ordered[: WORDS - 1], (END, 1)]
        root = np.sqrt([n for _, n in ordered])
        owner = np.minimum((np.cumsum(root) - root / 2) / root.sum() * CLASSES, CLASSES - 1).astype(int)
        self.words = {w: i for i, (w, _) in enumerate(ordered)}
        self.size = len(ordered)
        used = sorted(set(owner.tolist()))
        owner = np.searchsorted(used, owner)
        self.classes = len(used)
        self.owner = np.append(owner, self.classes).astype(np.int32)
        self.first = np.searchsorted(owner, np.arange(self.classes + 1))
        n = np.array([n for _, n in ordered], dtype=float)
        self.rest = max(total - n.sum(), 0.0)
        self.rest_types = max(types - len(ordered), 0)
        mass = np.append(np.bincount(owner, n, minlength=self.classes), self.rest + 1)
        self.class_bias = np.log(mass / mass.sum())
        self.word_bias = np.log(n)

    def start(self) -> dict[str, np.ndarray]:
        """Parameters before training: the unigram distribution, with small random weights."""
        r = np.random.default_rng(7)
        f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        return {"x": f(self.size + 2, 3 * UNITS), "u": f(UNITS, 3 * UNITS), "c": f(UNITS, self.classes + 1) * 0, "cb": self.class_bias.astype(np.float32), "w": f(UNITS, self.size) * 0, "wb": self.word_bias.astype(np.float32)}


def step(p: dict, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of the gated unit from inputs a and states h: new states, gates (update, reset), candidates and their recurrent part.

    A gate is (1 + tanh(s)) / 2, a logistic function of 2s.
    """
    b = h @ p["u"]
    zr = a[:, : 2 * UNITS] + b[:, : 2 * UNITS]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    m = b[:, 2 * UNITS :]
    n = zr[:, UNITS:] * m
    n += a[:, 2 * UNITS :]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[:, :UNITS]
    new += n
    return new, zr, n, m


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of these by row, in a range that floats can hold."""
    if a.size and a.max() > 60:
        a = a - a.max(axis=1, keepdims=True)
    e = np.exp(a)
    return a, e, e @ np.ones(e.shape[1], dtype=e.dtype)


def output(p: dict, shape: Shape, h: np.ndarray, y: np.ndarray, grad: dict | None = None):
    """log P of the words y (the class of others: of the class) after states h; with grad also what flows back to h."""
    order = np.argsort(shape.owner[y], kind="stable")
    h, y = h[order], y[order]
    owner, rows = shape.owner[y], np.arange(len(y))
    a, e, total = _exp(h @ p["c"] + p["cb"])
    out = a[rows, owner] - np.log(total)
    if grad is not None:
        e *= (-1 / total)[:, None]
        e[rows, owner] += 1
        grad["c"] += h.T @ e
        grad["cb"] += np.ones(len(e), dtype=e.dtype) @ e
        dh = e @ p["c"].T
    edge = np.searchsorted(owner, np.arange(shape.classes + 1))
    for k in range(shape.classes):
        mine = slice(edge[k], edge[k + 1])
        lo, hi = shape.first[k], shape.first[k + 1]
        if edge[k] == edge[k + 1] or hi - lo < 2:
            continue
        a, e, total = _exp(h[mine] @ p["w"][:, lo:hi] + p["wb"][lo:hi])
        at = rows[: len(a)], y[mine] - lo
        out[mine] += a[at] - np.log(total)
        if grad is not None:
            e *= (-1 / total)[:, None]
            e[at] += 1
            grad["w"][:, lo:hi] += h[mine].T @ e
            grad["wb"][lo:hi] += np.ones(len(e), dtype=e.dtype) @ e
            dh[mine] += e @ p["w"][:, lo:hi].T
    told = np.empty(len(y))
    told[order] = out
    if grad is None:
        return told
    flow = np.empty_like(dh)
    flow[order] = dh
    return told, flow


def _window(p: dict, shape: Shape, before: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, int]:
    """Gradients of one window (words before and words told, by time and row; -1: none) after states h, the states after it, and its words."""
    t, rows = y.shape
    real = y >= 0
    a = p["x"][np.maximum(before, 0)]
    hs = np.empty((t + 1, rows, UNITS), dtype=np.float32)
    zr = np.empty((t, rows, 2 * UNITS), dtype=np.float32)
    n, m = np.empty((t, rows, UNITS), dtype=np.float32), np.empty((t, rows, UNITS), dtype=np.float32)
    hs[0] = h
    for j in range(t):
        hs[j + 1], zr[j], n[j], m[j] = step(p, a[j], hs[j])
    grad = {k: np.zeros_like(q) for k, q in p.items()}
    _, flow = output(p, shape, hs[1:][real], y[real], grad)
    from_word = np.zeros((t, rows, UNITS), dtype=np.float32)
    from_word[real] = flow
    z, r = zr[:, :, :UNITS], zr[:, :, UNITS:]
    to_n = (1 - z) * (1 - n * n)
    to_z = (hs[:-1] - n) * z * (2 - 2 * z)
    to_r = m * r * (2 - 2 * r)
    back, candidate = np.empty((t, rows, 3 * UNITS), dtype=np.float32), np.empty((t, rows, UNITS), dtype=np.float32)
    dh, turned = np.zeros_like(h), p["u"].T.copy()
    for j in reversed(range(t)):
        dh += from_word[j]
        dn = np.multiply(dh, to_n[j], out=candidate[j])
        b = back[j]
        np.multiply(dh, to_z[j], out=b[:, :UNITS])
        np.multiply(dn, to_r[j], out=b[:, UNITS : 2 * UNITS])
        np.multiply(dn, r[j], out=b[:, 2 * UNITS :])
        dh *= z[j]
        dh += b @ turned
    back = back.reshape(-1, 3 * UNITS)
    grad["u"] = hs[:-1].reshape(-1, UNITS).T @ back
    back[:, 2 * UNITS :] = candidate.reshape(-1, UNITS)
    word = np.maximum(before, 0).ravel()
    order = np.argsort(word, kind="stable")
    edge = np.flatnonzero(np.diff(word[order], prepend=-1))
    grad["x"][word[order][edge]] = np.add.reduceat(back[order], edge, axis=0)
    return grad, hs[-1], int(real.sum())


def train(p: dict, shape: Shape, segments, rate: float) -> tuple[dict, int]:
    """Truncated backpropagation over an iterator of segments, with Adam; returns the parameters and the words seen.

    Segments come in batches of rows of SEGMENT words (-1: none). Gradients go
    back over BACK words; the state is carried from window to window.
    """
    p = {k: v.copy() for k, v in p.items()}
    m, v, t, seen = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, 0
    for rows in segments:
        length = (rows >= 0).sum(1)
        order = np.argsort(-length, kind="stable")
        told, length = np.ascontiguousarray(rows[order].T), length[order]
        h = np.zeros((len(rows), UNITS), dtype=np.float32)
        before = np.concatenate([np.full((1, len(rows)), shape.size + 1), told[:-1]])
        for a in range(0, len(told), BACK):
            live = int((length > a).sum())
            if not live:
                break
            grad, h, n = _window(p, shape, before[a : a + BACK, :live], told[a : a + BACK, :live], h[:live])
            t, seen = t + 1, seen + n
            for k in p:
                g = grad[k]
                g /= n
                np.clip(g, -1, 1, out=g)
                m[k] *= 0.9
                m[k] += 0.1 * g
                g *= g
                v[k] *= 0.99
                v[k] += 0.01 * g
                root = np.sqrt(v[k] / (1 - 0.99**t))
                root += 1e-6
                np.divide(m[k], root, out=root)
                root *= rate / (1 + t / 2000) / (1 - 0.9**t)
                p[k] += root
    return p, seen


def score(p: dict, shape: Shape, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihoods of documents (their words' numbers with the end), with the state carried over all windows."""
    out = np.zeros(len(docs))
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    for a in range(0, len(order), SIDE):
        mine = order[a : a + SIDE]
        size = np.array([len(docs[i]) for i in mine])
        h = np.zeros((len(mine), UNITS), dtype=np.float32)
        last = np.full(len(mine), shape.size + 1)
        for t in range(0, size[0], WINDOW):
            n = int((size > t).sum())
            rows = np.full((n, WINDOW), -1)
            for k in range(n):
                part = docs[mine[k]][t : t + WINDOW]
                rows[k, : len(part)] = part
            rows = np.ascontiguousarray(rows.T)
            hs = np.empty((WINDOW, n, UNITS), dtype=np.float32)
            h, last = h[:n], last[:n]
            live = np.minimum(size[:n] - t, WINDOW)
            for j in range(live[0]):
                k = int(np.searchsorted(-live, -j))
                h[:k] = hs[j, :k] = step(p, p["x"][last[:k]], h[:k])[0]
                last = rows[j]
            real = rows >= 0
            doc = np.broadcast_to(np.arange(n), rows.shape)[real]
            out[mine[:n]] += np.bincount(doc, output(p, shape, hs[real], rows[real]), minlength=n)
    return out


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(token, n) over all words and ends of docs, written. Tasks count before the shuffle."""

    def count(batches):
        for batch in batches:
            found = pc.value_counts(split(batch.column(0))[0])
            token, n = found.field("values"), found.field("counts")
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([token, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([batch.num_rows], pa.int64())])], names=["token", "n"])

    return written(docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")


def _hot(counts: DataFrame) -> tuple[pa.Array, np.ndarray, DataFrame]:
    """The most frequent tokens, at most HOT and none of more than HOT_BYTES, with their counts: those from the least count on that so few tokens reach (else the end alone); and the others' counts."""
    by_count = written(counts.groupBy("n").agg(F.count("*").alias("types")), "lm-spread")
    reach = by_count.withColumn("reach", F.sum("types").over(Window.orderBy(F.desc("n")))).where(F.col("reach") <= HOT)
    least = reach.agg(F.min("n")).first()[0]
    forget(by_count)
    is_hot = F.col("token") == F.lit(END) if least is None else (F.col("n") >= least) & (F.octet_length("token") <= HOT_BYTES)
    rows = counts.where(is_hot).orderBy(F.desc("n"), "token").toArrow()
    return rows["token"].combine_chunks(), rows["n"].to_numpy(), counts.where(~is_hot)


def segments(docs: DataFrame, key: str, text: str, shape: Shape) -> DataFrame:
    """(told, seq): every segment of all documents as the model's word numbers, and the number it is dealt by, written."""
    shared = docs.sparkSession.sparkContext.broadcast(shape)

    def cut(batches):
        words, other = pa.array(list(shared.value.words), pa.binary()), shared.value.size
        for batch in batches:
            tokens, of = split(batch.column(0))
            size = np.bincount(of, minlength=batch.num_rows) + 1
            flat = np.full(size.sum(), shared.value.words[END], dtype=np.int16)
            inner = np.ones(len(flat), dtype=bool)
            inner[np.cumsum(size) - 1] = False
            flat[inner] = pc.index_in(tokens, value_set=words).fill_null(other).to_numpy()
            pieces = -(-size // SEGMENT)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends = np.repeat(np.cumsum(size) - size, pieces) + np.minimum((piece + 1) * SEGMENT, np.repeat(size, pieces))
            rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(1).to_numpy(), pieces) + piece), rows], names=["told", "seq"])

    # the key is part of it, so that copies of a text are dealt to several trainers
    return written(docs.select(F.col(f"`{text}`").cast("string"), F.pmod(F.xxhash64(f"`{key}`", f"`{text}`"), F.lit(1 << 40)).alias("told")).mapInArrow(cut, "told long, seq array<smallint>"), "lm-segments")


def learned(docs: DataFrame, key: str, text: str, top: list[tuple[bytes, int]], total: int, types: int) -> tuple[Shape, dict]:
    """The model from every segment of all documents.

    Each segment is learned from once, in one of the ROUNDS. A round deals its
    segments to trainers, as many as the words need; each trains from the same
    parameters, and their mean, taken MEAN models a task until one is left, goes
    to the next round.
    """
    shape = Shape(top, total, types)
    sc = docs.sparkSession.sparkContext
    trainers = int(max(6, -(-total // PER_TRAINER)))
    parts = segments(docs, key, text, shape)
    shared = sc.broadcast(shape)
    p = shape.start()
    for r in range(ROUNDS):
        now = sc.broadcast(p)

        def fit(batches, now=now, rate=STEP / (r + 1)):
            def rows():
                held, size = np.zeros((0, SEGMENT), dtype=np.int64), FIRST
                for batch in batches:
                    seq = batch.column("seq")
                    new = np.full((len(seq), SEGMENT), -1, dtype=np.int64)
                    new[np.arange(SEGMENT) < seq.value_lengths().to_numpy()[:, None]] = seq.flatten().to_numpy()
                    held = np.concatenate([held, new])
                    while len(held) >= size:
                        yield held[:size]
                        held, size = held[size:], min(size + 4, BATCH)
                if len(held):
                    yield held

            q, seen = train(now.value, shared.value, rows(), rate)
            flat = np.concatenate([q[k].ravel() for k in sorted(q)])
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["seen", "flat"])

        def mean(batches):
            total, flat = 0, 0.0
            for batch in batches:
                for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total, flat = total + n, flat + np.frombuffer(x, np.float32).astype(float) * n
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([(flat / total).astype(np.float32).tobytes()], pa.binary())], names=["seen", "flat"])

        mine = parts.where(F.pmod(F.xxhash64("told"), F.lit(ROUNDS)) == r)
        models = mine.repartition(trainers, "told").sortWithinPartitions("told", F.xxhash64("seq")).mapInArrow(fit, "seen long, flat binary").where("seen > 0")
        left = trainers
        while left > 1:
            left = -(-left // MEAN)
            models = models.repartition(left).mapInArrow(mean, "seen long, flat binary")
        got = models.collect()
        now.destroy()
        if got:
            flat = np.frombuffer(got[0]["flat"], np.float32)
            out, at = {}, 0
            for k in sorted(p):
                out[k] = flat[at : at + p[k].size].reshape(p[k].shape).copy()
                at += p[k].size
            p = out
    forget(parts)
    shared.destroy()
    return shape, p


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """Unigram and recurrent log10-likelihoods of all documents, learned from those outside a fold of the key's crc32.

    Returns key, held_out, n_tokens, n_known, train_tokens, base_score, score.
    The recurrent model gives each word's class and its place in the class; a
    word of the last class has its smoothed share of that class's words, one
    share being left for all unseen ones. Counts of the HOT most frequent tokens
    are in the tasks, the other words of documents are joined with theirs.

    A null text is empty and has only the end; a null key counts as its text "".
    Repeated rows get equal scores. Without training rows all shares are even.
    """
    told = F.coalesce(F.col(key).cast("string"), F.lit(""))
    held = F.crc32(told) % folds == fold
    train_docs = docs.where(~held)
    counts = counted(train_docs, text)
    total, types = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    words, often, cold = _hot(counts)
    top = list(zip(words[:WORDS].to_pylist(), often[:WORDS].tolist()))
    shape, p = learned(train_docs, key, text, top, total, types)
    shared = docs.sparkSession.sparkContext.broadcast((shape, p, words, often))

    def run(batches):
        shape, _, words, often = shared.value
        size = len(words)
        logs = np.append(np.log10(often.astype(float) + 1), 0.0)
        # the model's word of each hot token, then of all others, then of the end
        model = np.full(size + 1, shape.size)
        at = pc.index_in(pa.array(list(shape.words), pa.binary()), value_set=words).to_numpy(zero_copy_only=False)
        known = ~np.isnan(at.astype(float))
        model[at[known].astype(int)] = np.array(list(shape.words.values()))[known]
        end = words.index(END).as_py()
        inside = np.where(model == shape.size, logs, 0.0)
        for batch in batches:
            edge = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(), dtype=np.int64))
            i = 0
            while i < batch.num_rows:
                j = min(max(i + 1, int(np.searchsorted(edge, edge[i] + HELD_BYTES, "right")) - 1), batch.num_rows)
                tokens, of = split(batch.column(1).slice(i, j - i))
                length = np.bincount(of, minlength=j - i) + 1
                starts = np.cumsum(length) - length
                word = np.ones(length.sum(), dtype=bool)
                word[starts + length - 1] = False
                at = np.full(len(word), end if end >= 0 else size)
                found = pc.index_in(tokens, value_set=words)
                at[word] = found.fill_null(size).to_numpy()
                seq = model[at]
                if end < 0:  # no row was trained on
                    seq[~word] = shape.words[END]
                total = lambda x: np.add.reduceat(x, starts)
                columns = [length, total((at < size).astype(np.int64)), total(logs[at]), total(inside[at]), total((seq == shape.size).astype(np.int64))]
                lost = found.is_null()
                rare = Counter(zip(of[lost.to_numpy(zero_copy_only=False)].tolist(), tokens.filter(lost).to_pylist()))
                pairs = pa.StructArray.from_arrays([pa.array([w for _, w in rare], pa.binary()), pa.array(list(rare.values()), pa.int64())], ["token", "k"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount([d for d, _ in rare], minlength=j - i))), pa.int32()), pairs)
                del tokens, of, found, lost, rare, at, word
                lm = score(shared.value[1], shape, np.split(seq, starts[1:])) / np.log(10)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *map(pa.array, columns), lists, pa.array(lm)], names=["key", "held_out", "n_tokens", "known", "base", "inside", "n_rest", "rare", "lm"])
                i = j

    source = docs.select(F.col(key).alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"))
    kind = source.schema["key"].dataType.simpleString()
    first = source.mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, known long, base double, inside double, n_rest long, rare array<struct<token: binary, k: long>>, lm double")
    rows = written(first.withColumn("row", F.monotonically_increasing_id()), "lm-first")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.k")
    more = rare.join(cold, "token").groupBy("row").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more"))
    all_rows = rows.drop("rare").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    rest = float(np.log10(shape.rest + shape.rest_types + 1))
    return all_rows.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * float(np.log10(total + types + 1))).alias("base_score"),
        (F.col("lm") + F.col("inside") + extra - F.col("n_rest") * rest).alias("score"),
    )
