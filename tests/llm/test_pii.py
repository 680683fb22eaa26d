import hashlib
import re

from lotline.llm import pii

from . import data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 13 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text or "") if valid(k, m[0])]


def cut(text, spans):
    """The text with its spans replaced by tags, overlapping ones by that of the first."""
    out, at = "", 0
    kinds = list(BASE)
    for s, e, kind in sorted((int(s), int(e), kinds.index(k)) for k, s, e in (x.split(":") for x in spans if x)):
        if s >= at:
            out += text[at:s] + f"<{kinds[kind].upper()}>"
        at = max(at, e)
    return out + text[at:]


AWKWARD = [
    "x@y.z@b.c a@b@c.d .@-.- a@b. a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3", "4111-1111 1111-1111 4111111111111112 4111 1111 1111 11112 4111  1111", "+1 (017) 555-7713 +1+23456789 +1234567890123456 +12-34-56-78)9 +1((((((((2",
    "\U0001f600 a@b.co \u00e9\u00e9 10.0.0.1", "9" * 5000, "a" * 20000, "a." * 8000, "1 " * 3000 + "x", "+1" + " " * 5000, "@" * 100, "4111 1111 1111 1111" * 3, None, "",
]


def test_base_spans_equal_regular_expressions(spark):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    for r in pii.extract(df).collect():
        want = brute(AWKWARD[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), AWKWARD[r["doc_id"]][:80]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_seeds_teach_contexts(spark):
    seeds = [f"{data.words(8, i)} ring me at +49 30 123456{i} soon" for i in range(6)]
    texts = [*seeds, "please ring me at (555) 123-4567, thanks", "the total was 5551234567 units", "ring me at home"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.extract(df).collect()}
    assert got[6]["n_context"] == 1 and got[7]["n_context"] == 0 and got[8]["n_context"] == 0
    kind, s, e = got[6]["spans"].split(":")
    assert kind == "phone" and texts[6][int(s) : int(e)] in "(555) 123-4567"


def test_awkward_rows_and_redaction(spark):
    df, rows = data.documents(spark)
    assert pii.extract(df).count() == len(rows)
    masked = pii.redacted(df)
    assert masked.columns == df.columns and masked.count() == len(rows)
    text = masked.where("doc_id = 16").first()["text"]
    again = pii.redacted(df.withColumnRenamed("key", "__hit").withColumnRenamed("row", "c1"))
    assert again.columns == [*df.columns[:-2], "__hit", "c1"] and again.where("doc_id = 16").first()["text"] == text
    assert text == "<EMAIL> <PHONE> <IP> <CARD> idiot"
    assert masked.where("text is null").count() == df.where("text is null").count()
    assert pii.extract(df.limit(0)).count() == 0 and pii.redacted(df.limit(0)).count() == 0


def test_redaction_cuts_the_told_spans(spark):
    """Texts of many spans and pieces, against cutting at the spans that extract() tells."""
    seeds = [f"ring me at +49 30 123456{i} soon" for i in range(6)]
    long = " ".join(f"\u00e9{i} a{i}@b.cd \U0001f600 4111 1111 1111 1111 +1.2.3.4.55555555" for i in range(700))
    texts = [*seeds, "ring me at (555) 123-4567, thanks", long, "x" * 511 + " a@b.co", "x" * 512 + " a@b.co " + "y" * 1030, "", *AWKWARD[:-2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    for r in pii.extract(df).collect():
        once = cut(texts[r["doc_id"]], r["spans"].split(","))
        assert got[r["doc_id"]] == (cut(once, brute(once)) if r["spans"] else once)
    assert "(555)" not in got[6]


def test_discovered_identifiers_teach_further_contexts(spark):
    """A pattern that no base match has is learned from numbers that another pattern discovered."""
    first = [f"{data.words(3, i)} ring me at +49 30 123456{i} soon" for i in range(8)]
    second = [f"ring me at 555123000{i}" for i in range(4)]
    third = [f"{data.words(3, 50 + i)} office desk line 555123000{i} here" for i in range(4)]
    df = spark.createDataFrame(list(enumerate([*first, *second, *third, "my desk line 7778889990 here", "sum of 7778889991 units"])), "doc_id long, text string")
    got = {r["doc_id"]: r["n_context"] for r in pii.extract(df).collect()}
    assert [got[i] for i in range(8, 16)] == [1] * 8 and got[16] == 1 and got[17] == 0
