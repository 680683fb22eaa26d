import io
import wave

import numpy as np

from lotline.llm import media


def wav(notes, rate=media.RATE):
    t = np.arange(256) / rate
    x = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes]) * 9000
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.astype("<i2").tobytes())
    return raw.getvalue()


def test_codes_equal_plain_areas():
    frames = media.chroma(media.samples(wav(np.random.default_rng(1).integers(0, 24, 40))))
    got = media.codes(frames)
    assert len(got) == len(frames) - media.SPAN + 1 and got.min() >= 0 and got.max() < 2**32
    a, b = frames[3 : 3 + 8, 0:2].sum(), frames[11 : 11 + 8, 0:2].sum()
    level = int(np.searchsorted(media.EDGES, np.log((a + 0.1) / (b + 0.1))))
    assert (int(got[3]) >> 30) == level ^ (level >> 1)


def test_alignment(spark):
    r = np.random.default_rng(2)
    song = r.integers(0, 24, 60)
    rows = [(0, wav(song)), (1, wav(song)), (2, wav(np.concatenate([r.integers(0, 24, 10), song]))), (3, wav(r.integers(0, 24, 60))), (4, None), (5, b"noise"), (6, wav(song[:3])), (7, wav(song[20:]))]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = {r["key"]: r for r in media.aligned(media.fingerprints(df), lambda k: k == 0).collect()}
    assert len(got) == 8 and got[1]["class_id"] == 0 and got[3]["query_id"] is None
    assert got[2]["query_id"] == 0 and got[2]["offset"] == 20 and got[2]["bit_error"] < 0.05
    assert got[7]["query_id"] == 0 and got[7]["offset"] == -40
    assert [got[i]["n_codes"] for i in (4, 5, 6)] == [0, 0, 0]
    assert media.aligned(media.fingerprints(df.limit(0)), lambda k: k == 0).count() == 0


def test_all_queries_that_match(spark):
    r = np.random.default_rng(3)
    song = r.integers(0, 24, 60)
    rows = [(0, wav(song)), (1, wav(song[20:])), (2, wav(song[20:])), (3, wav(r.integers(0, 24, 60))), (10, wav(np.concatenate([r.integers(0, 24, 10), song])))]
    got = media.aligned(media.fingerprints(spark.createDataFrame(rows, "id long, media binary")), lambda k: k % 10 == 0).collect()
    told = {(x["key"], x["query_id"]): x["offset"] for x in got}
    assert len(got) == len(told)
    # 2 is equal to 1, which stands for both
    assert told == {(0, 10): -20, (10, 0): 20, (1, 0): -40, (1, 10): -60, (2, None): None, (3, None): None}
    assert {(x["key"], x["class_id"], x["n_links"], x["query_class"]) for x in got} == {(0, 0, 1, 0), (10, 10, 1, 10), (1, 1, 2, None), (2, 1, 2, None), (3, 3, 0, None)}


def test_queries_among_equal_recordings(spark):
    """A class is named by its least key, but told as a query by its least query; many equal recordings cost a row each."""
    r = np.random.default_rng(5)
    song = r.integers(0, 24, 60)
    rows = [(k, wav(song)) for k in (5, 100, 200, 7)] + [(300 + i, wav(song[10:])) for i in range(1, 30)] + [(8, wav(r.integers(0, 24, 60)))]
    got = media.aligned(media.fingerprints(spark.createDataFrame(rows, "id long, media binary").repartition(3)), lambda k: k % 100 == 0).collect()
    assert len(got) == len(rows)
    assert {(x["class_id"], x["query_class"], x["n_links"]) for x in got if x["key"] in (5, 7, 100, 200)} == {(5, 100, 0)}
    assert {(x["class_id"], x["n_links"]) for x in got if x["key"] > 300} == {(301, 1)}
    assert [(x["key"], x["query_id"], x["offset"]) for x in got if x["query_id"] is not None] == [(301, 100, -20)]


def noisy(raw, level, seed):
    with wave.open(io.BytesIO(raw)) as w:
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float)
    x = x + np.random.default_rng(seed).normal(0, level, len(x))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(media.RATE)
        w.writeframes(np.clip(x, -32000, 32000).astype("<i2").tobytes())
    return out.getvalue()


def silent(seconds):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(media.RATE)
        w.writeframes(bytes(2 * int(seconds * media.RATE)))
    return out.getvalue()


def brute(codes, query, other):
    """(shared, offset, share of wrong bits) of the best offset, over all pairs of places."""
    x, y = codes[query], codes[other]
    count = {}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            if a == b != media.SILENT:
                count[j - i] = count.get(j - i, 0) + 1
    best = max(((n, -abs(o), o) for o, n in count.items()), default=None)
    if best is None or best[0] < media.LEAST_CODES:
        return None
    o = best[2]
    bits = [int(x[i] ^ y[i + o]).bit_count() for i in range(len(x)) if 0 <= i + o < len(y) and media.SILENT not in (x[i], y[i + o])]
    error = sum(bits) / (32 * len(bits))
    return (best[0], o, round(error, 9)) if error <= media.MOST_ERRORS else None


def test_alignment_equals_brute_force(spark):
    """All pairs of recordings: noisy ones, parts, held tones of several lengths, silence, repeated and null keys."""
    r = np.random.default_rng(7)
    song = r.integers(0, 24, 50)
    rows = [(0, wav(song)), (10, wav(song[5:40])), (20, wav([3] * 30)), (30, silent(2)), (1, noisy(wav(song), 300, 1)), (2, wav([3] * 45)), (3, wav([5] * 40)), (4, silent(3)), (5, wav([*song[:20], *[3] * 20])), (6, wav(np.tile(song[:12], 4))), (6, wav(song[10:])), (None, wav(song[:30]))]
    df = spark.createDataFrame(rows, "id long, media binary")
    codes = [media.codes(media.chroma(media.samples(m))).tolist() for _, m in rows]
    want = {(rows[q][0], rows[i][0], i): b for q in range(4) for i in range(len(rows)) if codes[i] != codes[q] and (b := brute(codes, q, i))}
    got = media.aligned(media.fingerprints(df), lambda k: k % 10 == 0).where("query_id is not null").collect()
    assert sorted((x["query_id"], x["key"] or -1, x["shared"], x["offset"], round(x["bit_error"], 9)) for x in got) == sorted((q, k or -1, *b) for (q, k, _), b in want.items())
    assert any(k == 2 and q == 20 for q, k, _ in want)


def test_recall_of_noisy_parts(spark):
    """Of 40 noisy and cut copies of queries nine in ten at least are found."""
    r = np.random.default_rng(11)
    songs = {10 * i: r.integers(0, 24, 60) for i in range(40)}
    rows = [(k, wav(s)) for k, s in songs.items()]
    rows += [(k + 1, noisy(wav(s[15:50]), 400, k)) for k, s in songs.items()]
    got = {(x["key"], x["query_id"]) for x in media.aligned(media.fingerprints(spark.createDataFrame(rows, "id long, media binary")), lambda k: k % 10 == 0).collect()}
    assert sum((k + 1, k) in got for k in songs) >= 36
