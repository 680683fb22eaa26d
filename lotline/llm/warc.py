"""WARC archives as a Python data source, and pages with equal payloads as revisits."""

from __future__ import annotations

import base64
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import forget, maybe_among, shared_dir, written

#: Bytes after which a writer begins another file, and bytes of files that one reading task takes.
FILE_BYTES = PART_BYTES = 64 << 20
#: Columns that predicates are pushed down on, and their header fields.
FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest"}
READ = ", ".join(f"{c} string" for c in FIELDS) + ", content_length long, headers map<string, string>, payload binary, file string, offset long"
ARROW = pa.schema([*((c, pa.string()) for c in FIELDS), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
#: What a reader takes from a file at once: after a jump, and at most where it reads on.
CHUNK, AHEAD = 1 << 16, 4 << 20
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(record: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed and uncompressed length, so readers can skip it."""
    packer = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    sizes = (32 + len(body)).to_bytes(4, "little") + len(record).to_bytes(4, "little")
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + sizes
    return head + body + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = [f"{k}: {v.replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A') if k == 'WARC-Target-URI' else v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    """The header fields of a record, by name as written."""
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    out = {k.strip(): v.strip() for k, _, v in pairs}
    if "WARC-Target-URI" in out:
        out["WARC-Target-URI"] = out["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return out


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a response; else the whole block."""
    return block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("Content-Type", "") else block


class Ahead:
    """A stream whose small reads are served from a block that was read ahead; blocks double while reading goes on and begin at CHUNK after a jump."""

    def __init__(self, stream):
        self.stream, self.end, self.at, self.begin, self.block, self.size = stream, stream.size(), 0, 0, b"", CHUNK
        self.fetched = 0

    def seek(self, at: int) -> None:
        self.at = at

    def tell(self) -> int:
        return self.at

    def read(self, n: int) -> bytes:
        n = max(min(n, self.end - self.at), 0)
        if not self.begin <= self.at <= self.at + n <= self.begin + len(self.block):
            on = self.begin <= self.at <= self.begin + len(self.block)
            self.size = min(2 * self.size, AHEAD) if on and self.block else CHUNK
            kept = self.block[self.at - self.begin :] if on else b""
            self.stream.seek(self.at + len(kept))
            self.block, self.begin = kept + self.stream.read(max(n - len(kept), self.size)), self.at
            self.fetched += len(self.block) - len(kept)
        out = self.block[self.at - self.begin : self.at - self.begin + n]
        self.at += len(out)
        return out


def _length(fields: dict[str, str], found: int) -> int:
    """The length a header tells, or what was found where it tells none."""
    told = fields.get("Content-Length", "")
    return int(told) if told.isdecimal() else found


def records(stream, compressed: bool, wanted, decode: bool):
    """(offset, fields, payload or None) of the records that wanted(fields) takes.

    Headers come first: of a compressed record only its first bytes are
    decompressed, and an unwanted or unneeded block is skipped by seeking (by
    decompressing without keeping it where a member doesn't tell its length).
    A record that ends before its length is told with the field WARC-Truncated;
    one without a length that is a number goes to the end of its member, in a
    plain file to the end of the file.
    """
    stream = Ahead(stream)
    offset, end = 0, stream.end
    while offset < end:
        stream.seek(offset)
        raw = stream.read(CHUNK)
        if compressed:
            told = int.from_bytes(raw[16:20], "little") if raw[3:4] == b"\x04" and raw[12:14] == b"sl" else 0
            unpack, data, fed = zlib.decompressobj(31), b"", raw
            while b"\r\n\r\n" not in data and fed:
                data += unpack.decompress(fed, 4096)
                fed = unpack.unconsumed_tail or ("" if unpack.eof else stream.read(CHUNK))
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = fields_of(head)
            take = wanted(fields)
            read = len(raw)
            if take and decode or not told:
                kept = [rest]
                while not unpack.eof and fed:
                    more = unpack.decompress(fed, 1 << 20)
                    kept.append(more if take and decode else b"")
                    fed = unpack.unconsumed_tail or ("" if unpack.eof else stream.read(CHUNK))
                rest = b"".join(kept)
                read = stream.tell() - offset - len(unpack.unused_data)
            if take:
                size = _length(fields, len(rest))
                if decode and len(rest) < size:
                    fields["WARC-Truncated"] = "length"
                yield offset, fields, payload_of(fields, rest[:size]) if decode else None
            offset += told or read
        else:
            while b"\r\n\r\n" not in raw and (more := stream.read(CHUNK)):
                raw += more
            skip = len(raw) - len(raw.lstrip(b"\r\n"))
            head, found, _ = raw[skip:].partition(b"\r\n\r\n")
            if not found:
                return
            fields = fields_of(head)
            start = offset + skip + len(head) + 4
            size = _length(fields, end - start)
            if wanted(fields):
                block = b""
                if start + size > end:
                    fields["WARC-Truncated"] = "length"
                if decode:
                    stream.seek(start)
                    block = stream.read(size)
                yield offset + skip, fields, payload_of(fields, block) if decode else None
            offset = start + size + 4


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.decode, self.tests = options["path"], str(options.get("payload", "true")).lower() == "true", []

    def pushFilters(self, filters):
        """Takes equality, in, prefix and not-null tests of header columns; the others stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                values = {EqualTo: lambda f: [f.value], In: lambda f: list(f.value), StringStartsWith: lambda f: f.value, IsNotNull: lambda f: None}[type(f)](f)
                self.tests.append((FIELDS[f.attribute[0]], type(f).__name__, values))
            else:
                yield f

    def partitions(self):
        """Files in order, as many to a task as have PART_BYTES together."""
        from pyarrow import fs

        system, root = _fs(self.path)
        one = system.get_file_info(root)
        every = [one] if one.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((x.path, x.size) for x in every if x.path.endswith((".warc", ".warc.gz")) and x.size)
        parts, paths, size = [], [], 0
        for path, n in found:
            if paths and size + n > PART_BYTES:
                parts.append(Files(tuple(paths)))
                paths, size = [], 0
            paths.append(path)
            size += n
        return [*parts, Files(tuple(paths))]

    def read(self, partition):
        def wanted(fields):
            for name, kind, value in self.tests:
                x = fields.get(name)
                if x is None or kind in ("EqualTo", "In") and x not in value or kind == "StringStartsWith" and not x.startswith(value):
                    return False
            return True

        system, _ = _fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for offset, fields, payload in records(stream, path.endswith(".gz"), wanted, self.decode):
                    rows.append({c: fields.get(h) for c, h in FIELDS.items()} | {"content_length": _length(fields, 0), "headers": list(fields.items()), "payload": payload, "file": path, "offset": offset})
                    size += len(payload or b"") + 500
                    if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Wrote(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of (warc_type, record_id, refers_to, target_uri, date, sha1, headers, payload).

    A try of a task writes files of its own names, which get their last name when
    the job commits.
    """

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        system, root = _fs(self.path)
        system.create_dir(root, recursive=True)
        paths, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(f"{root}/{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(paths[-1] + ".open", compression=None), 0
                packed = member(self.record(row))
                out.write(packed)
                size += len(packed)
        if out:
            out.close()
        return Wrote(paths)

    @staticmethod
    def record(row) -> bytes:
        extra = dict(row["headers"] or ())
        digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()
        fields = {"WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row["date"], "WARC-Target-URI": row["target_uri"], "WARC-Payload-Digest": digest, "WARC-Refers-To": row["refers_to"], **extra}
        if row["refers_to"]:
            fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        payload = row["payload"] or b""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return record(fields | {"Content-Type": "application/http; msgtype=response"}, http + payload)

    def commit(self, messages):
        system, _ = _fs(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.move(path + ".open", path)

    def abort(self, messages):
        system, _ = _fs(self.path)
        for path in (p for m in messages if m for p in m.paths):
            system.delete_file(path + ".open")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, with filters pushed down to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archived(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record a page to path.

    Of pages with equal payloads of at least `least` bytes, that with the
    smallest key is a response and the others are revisits without payload.
    Payloads are grouped by their SHA-1; null html is an empty payload. Pages
    that repeat the smallest key, or of a payload that has no key at all, are
    responses too; a null url gives no target.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha1", F.sha1("body"))
    # of payloads that come once nothing is joined, and bodies are shuffled only where a page may be a revisit
    narrow = written(rows.select("key", "sha1", (F.length("body") >= least).alias("large")), "warc-pages")
    first = narrow.where("large").groupBy("sha1").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha1", "first")
    again = written(narrow.where("large").join(first, "sha1").where(~F.col("key").eqNullSafe(F.col("first"))).select(F.col("key").alias("k"), F.col("sha1").alias("s"), "first").distinct(), "warc-revisits")
    forget(narrow)
    asked = maybe_among(rows, F.col("sha1"), again.select("s").distinct())
    met = asked.where("__hit").join(again, (F.col("sha1") == F.col("s")) & F.col("key").eqNullSafe(F.col("k")), "left")
    columns = ["key", "url", "sha1", "body"]
    told = asked.where("not __hit").select(*columns, F.lit(None).cast(dict(again.dtypes)["first"]).alias("first")).unionByName(met.select(*columns, "first")).withColumn("again", F.col("first").isNotNull())
    named = lambda k: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", F.coalesce(k.cast("string"), F.lit("")), "sha1")), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    headers = F.map_filter(
        F.create_map(F.lit("X-Page-Id"), F.col("key").cast("string"), F.lit("X-Payload-Bytes"), F.length("body").cast("string"), F.lit("X-Refers-To-Page-Id"), F.when(F.col("again"), F.col("first").cast("string"))),
        lambda k, v: v.isNotNull(),
    )
    told.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("warc_type"),
        named(F.col("key")).alias("record_id"),
        F.when(F.col("again"), named(F.col("first"))).alias("refers_to"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        "sha1",
        headers.alias("headers"),
        F.when(~F.col("again"), F.col("body")).alias("payload"),
    ).write.format("warc").mode("append").save(path)
    forget(again)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of hexadecimal digits, five of which are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    part = lambda i, k: F.substring(letters, (F.shiftright(F.conv(F.substring(hexadecimal, 5 * i + 1, F.lit(5)), 16, 10).cast("long"), 15 - 5 * k) % 32).cast("int") + 1, F.lit(1))
    fives = F.sequence(F.lit(0), F.floor(F.length(hexadecimal) / 5).cast("int") - 1)
    return F.array_join(F.transform(fives, lambda i: F.concat(*(part(i, k) for k in range(4)))), "")


def digest(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to an archive in the shared folder and tells what reading it back gives.

    Responses are read with their payloads, of which length and SHA-1 are taken
    anew; revisits are read by their headers alone and take both from the response
    that they refer to.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archived(pages, path, least=least)
    read = lambda payload: spark.read.format("warc").option("payload", payload).load(path)
    page = F.col("headers")["X-Page-Id"].cast("long").alias("page_id")
    full = written(read("true").where("warc_type = 'response'").select("record_id", page, F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest")), "warc-responses")
    known = full.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    again = read("false").where("warc_type = 'revisit'").select("refers_to", page, F.col("headers")["X-Refers-To-Page-Id"].cast("long").alias("first"))
    revisits = again.join(known, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    return full.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)
