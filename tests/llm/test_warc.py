import base64
import gzip
import hashlib
import io
import tempfile

import pyarrow as pa

from lotline.llm import warc

from . import data


def test_pages_read_back(spark):
    big = data.words(30000, 1)
    html = ["same", "same", None, "", "unique é", big, "same", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "x\r\n\r\ny", big]
    rows = [(9 - i, f"http://a.net/{i}\r\nX: y%0A" if i % 3 else None, h, "clash") for i, h in enumerate(html)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, warc_type string")
    first = {}
    for p, _, h, _ in sorted(rows):
        first.setdefault(h or "", p)
    got = {r["page_id"]: r for r in warc.digest(df).collect()}
    assert len(got) == len(rows)
    for p, _, h, _ in rows:
        body, f = (h or "").encode(), first[h or ""]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if f == p else "revisit", None if f == p else f)
        assert tuple(got[p][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert {r["record_type"] for r in warc.digest(df, least=5).where("payload_bytes < 5").collect()} == {"response"}
    assert warc.digest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(r["record_type"] for r in warc.digest(twice).collect()) == ["response"] * 3 + ["revisit"]


def test_predicates_and_columns(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(1, "http://a/1", "x"), (2, "http://b/2", "x"), (3, "http://b/3", "y")], "page_id long, url string, html string")
    warc.archived(df, f"file://{path}/w")
    read = spark.read.format("warc").load(f"file://{path}/w")
    assert sorted((r["target_uri"], bytes(r["payload"])) for r in read.collect()) == [("http://a/1", b"x"), ("http://b/2", b""), ("http://b/3", b"y")]
    some = read.where("warc_type = 'response' and target_uri like 'http://b/%'")
    assert [r["target_uri"] for r in some.collect()] == ["http://b/3"]
    assert [r["target_uri"] for r in read.where("refers_to is not null").collect()] == ["http://b/2"]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]


def test_plain_and_foreign_files():
    made = [warc.record({"WARC-Type": t, "Content-Type": "text/plain"}, b) for t, b in (("warcinfo", b"a" * 100000), ("response", b"hello"), ("metadata", b""))]
    plain = pa.BufferReader(b"".join(made))
    packed = pa.BufferReader(b"".join(gzip.compress(m) for m in made))
    own = pa.BufferReader(b"".join(warc.member(m) for m in made))
    for stream, squeezed in ((plain, False), (packed, True), (own, True)):
        found = [(f["WARC-Type"], p) for _, f, p in warc.records(stream, squeezed, lambda f: True, True)]
        assert found == [("warcinfo", b"a" * 100000), ("response", b"hello"), ("metadata", b"")]
        only = [p for _, f, p in warc.records(stream, squeezed, lambda f: f["WARC-Type"] == "response", True)]
        assert only == [b"hello"]
    assert gzip.GzipFile(fileobj=io.BytesIO(warc.member(b"x" * 999))).read() == b"x" * 999


def test_reading_ahead_and_broken_records():
    made = [warc.record({"WARC-Type": "response", "Content-Type": "text/plain"}, b"b%d" % i) for i in range(5000)]
    for stream, squeezed in ((b"".join(made), False), (b"".join(map(warc.member, made)), True)):
        source = pa.BufferReader(stream)
        ahead = warc.Ahead(source)
        assert ahead.read(10) == stream[:10] and ahead.fetched >= 10
        assert [p for _, _, p in warc.records(source, squeezed, lambda f: True, True)] == [b"b%d" % i for i in range(5000)]
    short = pa.BufferReader(made[0] + made[1][:-6])
    found = [(f.get("WARC-Truncated"), p) for _, f, p in warc.records(short, False, lambda f: True, True)]
    assert found == [(None, b"b0"), ("length", b"")]
    odd = made[0].replace(b"Content-Length: 2", b"Content-Length: ?")
    assert [p for _, _, p in warc.records(pa.BufferReader(gzip.compress(odd)), True, lambda f: True, True)] == [b"b0\r\n\r\n"]


def test_one_file_is_a_path(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"".join(warc.record({"WARC-Type": t, "Content-Type": "text/plain"}, b"x") for t in ("response", "metadata")))
    warc.register(spark)
    assert spark.read.format("warc").load(f"file://{tmp_path}/a.warc").count() == 2


def test_small_records_are_fetched_about_once():
    data = b"".join(warc.member(warc.record({"WARC-Type": "revisit", "Content-Type": "text/plain"}, b"")) for _ in range(20000))

    class Counting:
        def __init__(self):
            self.inner, self.n = pa.BufferReader(data), 0

        def size(self):
            return self.inner.size()

        def seek(self, at):
            self.inner.seek(at)

        def read(self, n):
            out = self.inner.read(n)
            self.n += len(out)
            return out

    stream = Counting()
    assert sum(1 for _ in warc.records(stream, True, lambda f: True, False)) == 20000 and stream.n <= 1.1 * len(data)
