"""Chroma fingerprints of recordings in a media column, and their alignment."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Samples a second that recordings are brought to, samples of a window and between windows.
RATE, WINDOW, HOP = 4000, 512, 128
#: Frequencies that count, and that of pitch class 0.
LOW, HIGH, TONE = 110.0, 1760.0, 220.0
#: Frames that the widest filter covers; filters, of two bits each.
SPAN, FILTERS = 16, 16
#: Stands for a place without sound; such places are compared with nothing.
SILENT = -1
#: Edges of the four values of a filter's log-ratio.
EDGES = (-0.2, 0.0, 0.2)
#: Bytes of recordings that are made in one batch.
BATCH_BYTES = 8 << 20
#: Frames of recordings of one length that the filters go over at once.
TOGETHER = 16_000
#: Shared codes at the best offset and share of wrong bits that make a match.
LEAST_CODES, MOST_ERRORS = 4, 0.25


def samples(media: bytes | None) -> np.ndarray:
    """Mono samples of a 16-bit PCM WAV file at RATE (nearest sample); none of what is no such file."""
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
            x = x[: len(x) // w.getnchannels() * w.getnchannels()].reshape(-1, w.getnchannels()).mean(1)
            return x if w.getframerate() == RATE else x[(np.arange(int(len(x) * RATE / w.getframerate())) * w.getframerate() / RATE).astype(int)]
    except (wave.Error, EOFError):
        return np.zeros(0)


_BINS = np.fft.rfftfreq(WINDOW, 1 / RATE)
_USED = np.flatnonzero((_BINS >= LOW) & (_BINS <= HIGH))
_CLASS = np.eye(12)[np.round(12 * np.log2(_BINS[_USED] / TONE)).astype(int) % 12]
_TAPER = np.hanning(WINDOW)


def chroma(x: np.ndarray) -> np.ndarray:
    """Frames of energy by pitch class, each of length 1."""
    n = (len(x) - WINDOW) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP][:n]
    z = np.fft.rfft(frames * _TAPER, axis=1)[:, _USED]
    energy = (z.real**2 + z.imag**2) @ _CLASS
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, energy / np.maximum(size, 1e-6), 0)


def codes(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit integer for each place where SPAN frames fit.

    Filter i compares the areas of two neighbouring rectangles of the image of
    frames: side by side in time or in pitch, in thirds of time, or crosswise by
    i mod 4; where it lies in pitch and how wide it is follow from i. Areas are
    differences of the integral image; the log of the areas' ratio gives two Gray
    coded bits. Places where all frames are silent have SILENT instead.
    """
    return coded(frames[None])[0]


def coded(frames: np.ndarray) -> np.ndarray:
    """codes() of many recordings with equal numbers of frames: a line each."""
    n = frames.shape[1] - SPAN + 1
    if n < 1:
        return np.zeros((len(frames), 0), dtype=np.int64)
    image = np.zeros((13, len(frames), frames.shape[1] + 1))
    image[1:, :, 1:] = np.cumsum(np.cumsum(frames, axis=1), axis=2).transpose(2, 0, 1)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[p1, :, t1 : t1 + n] - image[p1, :, t0 : t0 + n] - image[p0, :, t1 : t1 + n] + image[p0, :, t0 : t0 + n]

    out = np.zeros((len(frames), n), dtype=np.int64)
    for i in range(FILTERS):
        p, h, w = (i * 5) % 9, 2 + i % 3, SPAN - 4 * (i % 3)
        q, half, third = min(p + h, 12), w // 2, w // 3
        mid = (p + q + 1) // 2
        if i % 4 == 0:
            a, b = area(0, half, p, q), area(half, w, p, q)
        elif i % 4 == 1:
            a, b = area(0, w, p, mid), area(0, w, mid, q)
        elif i % 4 == 2:
            a, b = 2 * area(third, 2 * third, p, q), area(0, third, p, q) + area(2 * third, 3 * third, p, q)
        else:
            a, b = area(0, half, p, mid) + area(half, w, mid, q), area(0, half, mid, q) + area(half, w, p, mid)
        level = np.searchsorted(EDGES, np.log((a + 0.1) / (b + 0.1)))
        out = (out << 2) | (level ^ (level >> 1))
    return np.where(area(0, SPAN, 0, 12) > 0, out, SILENT)


def fingerprints(media: DataFrame, key: str = "id", column: str = "media") -> DataFrame:
    """(key, codes) of each recording; bytes that are no 16-bit PCM WAV file, null and short ones have no codes.

    Recordings are decoded one at a time, and the filters go over those of equal
    length together, up to TOGETHER frames; Spark bounds what a batch holds in bytes.
    """

    def run(batches):
        for batch in batches:
            found: list = [None] * batch.num_rows
            held: dict[int, list[tuple[int, np.ndarray]]] = {}

            def close(length: int) -> None:
                rows, frames = zip(*held.pop(length))
                for i, x in zip(rows, coded(np.stack(frames))):
                    found[i] = x

            for i, x in enumerate(batch.column(1)):
                frames = chroma(samples(x.as_py()))
                own = held.setdefault(len(frames), [])
                own.append((i, frames))
                if len(own) * len(frames) >= TOGETHER:
                    close(len(frames))
            for length in list(held):
                close(length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "codes"])

    kind = dict(media.dtypes)[key]
    return media.select(F.col(key).alias("key"), F.col(column).alias("media")).mapInArrow(run, f"key {kind}, codes array<long>")


def _runs(classes: DataFrame) -> DataFrame:
    """(c, query, at, length, code): stretches of one code, without silence."""
    n = F.size("codes")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("codes", i) != F.get("codes", i - 1)))
    runs = F.transform("starts", lambda s, k: F.struct(s.alias("at"), (F.coalesce(F.get("starts", k + 1), n) - s).alias("length"), F.get("codes", s).alias("code")))
    return classes.withColumn("starts", starts).select("c", "query", F.inline(runs)).where(F.col("code") != SILENT)


def aligned(prints: DataFrame, is_query) -> DataFrame:
    """A row for each recording, and for the one that stands for its class a row for each query class that it matches.

    All rows have class_id, n_codes, query_class (the least key among the queries
    of its own class; null if there are none) and n_links, the number of other
    classes with queries that its class matches. Recordings of equal codes are one
    class, named by its least key. The links of a class are told once, in the rows
    of one of its recordings with that key: query_id (the least query key of the
    class matched), offset, shared and bit_error; all other rows have nulls there.
    So equal recordings cost a row each, however many queries they match.

    Codes of query classes fetch the classes that have them; the offsets of these
    hits are counted (a grouped sum, combined before its shuffle), and the pair's
    best offset is judged by the share of wrong bits where both sound. Ties go to
    the smaller offset. Stretches of one code, as in a held tone, are joined as
    one row each and silence is left out, so a constant recording costs a row and
    its offsets, not the square of its length; the rows of a code that very many
    recordings have are split by Spark's skewed join.

    Repeated keys are recordings of their own and are returned as often as they
    come; a null key is never a query.
    """
    rows = written(prints.withColumn("print", F.sha2(F.array_join("codes", ","), 256)).withColumn("row", F.monotonically_increasing_id()), "media-prints")
    asks = F.coalesce(is_query(F.col("key")), F.lit(False))
    grouped = rows.where("size(codes) > 0").groupBy("print").agg(F.min("key").alias("class_id"), F.min_by("row", F.struct(F.col("key").isNull(), "key", "row")).alias("stands"), F.min(F.when(asks, F.col("key"))).alias("query_class"), F.first("codes").alias("codes"))
    classes = written(grouped.withColumn("query", F.col("query_class").isNotNull()).withColumn("c", F.monotonically_increasing_id()), "media-classes")
    runs = written(_runs(classes), "media-runs")
    asked = runs.where("query").select(F.col("c").alias("q"), F.col("at").alias("query_at"), F.col("length").alias("query_length"), "code")
    met = runs.join(asked, "code").where("c <> q").withColumn("offset", F.explode(F.sequence(F.expr("at - query_at - query_length + 1"), F.expr("at - query_at + length - 1"))))
    both = F.expr("least(at + length, query_at + offset + query_length) - greatest(at, query_at + offset)")
    hits = met.groupBy("q", "c", "offset").agg(F.sum(both).alias("shared"))
    best = hits.groupBy("q", "c").agg(F.max(F.struct("shared", (-F.abs("offset")).alias("near"), "offset")).alias("b")).where(F.col("b.shared") >= LEAST_CODES)
    pairs = best.select("q", "c", "b.shared", "b.offset").join(classes.select(F.col("c").alias("q"), F.col("query_class").alias("query_id"), F.col("codes").alias("x")), "q").join(classes.select("c", F.col("codes").alias("y")), "c")
    places = F.filter(F.sequence(F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("x"), F.size("y") - F.col("offset")) - 1), lambda i: (F.get("x", i) != SILENT) & (F.get("y", (i + F.col("offset")).cast("int")) != SILENT))
    wrong = F.aggregate("places", F.lit(0), lambda a, i: a + F.bit_count(F.get("x", i).bitwiseXOR(F.get("y", (i + F.col("offset")).cast("int")))))
    judged = pairs.withColumn("places", places).select("query_id", "c", "shared", "offset", (wrong / (32.0 * F.size("places"))).alias("bit_error")).where(F.col("bit_error") <= MOST_ERRORS)
    links = written(judged, "media-links")
    forget(runs)
    number = links.groupBy("c").agg(F.count("*").alias("n_links"))
    named = written(classes.select(F.col("print").alias("p"), "class_id", "query_class", "stands", "c").join(number, "c", "left"), "media-named")
    own = rows.join(named, F.col("print") == F.col("p"), "left")
    told = links.join(named.select("c", "stands"), "c").drop("c")
    out = written(own.join(told.withColumnRenamed("stands", "row"), "row", "left"), "media-aligned")
    forget(classes, links, named, rows)
    return out.select("key", F.coalesce("class_id", "key").alias("class_id"), F.size("codes").cast("long").alias("n_codes"), "query_class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "query_id", F.col("offset").cast("long").alias("offset"), "shared", "bit_error")


def played(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, media): each vector as a recording, a note of HOP * 2 samples a coordinate, its pitch by the coordinate's size."""

    def run(batches):
        t = np.arange(2 * HOP) / RATE
        tones = np.sin(2 * np.pi * TONE * 2 ** (np.arange(24) / 12)[:, None] * t[None]) * 12000
        for batch in batches:
            vectors, keys, out, size = batch.column(1), [], [], 0
            for i in range(len(vectors)):
                x = np.array([c if c is not None else 0.0 for c in vectors[i].as_py() or ()], dtype=float)
                note = np.clip(np.floor(12 + 8 * x / (np.std(x) or 1.0)), 0, 23).astype(int)
                raw = io.BytesIO()
                with wave.open(raw, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(RATE)
                    w.writeframes(tones[note].astype("<i2").tobytes())
                out.append(raw.getvalue())
                keys.append(i)
                size += len(out[-1])
                if size > BATCH_BYTES or i == len(vectors) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(out, pa.binary())], names=[key, "media"])
                    keys, out, size = [], [], 0

    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {dict(vectors.dtypes)[key]}, media binary")
