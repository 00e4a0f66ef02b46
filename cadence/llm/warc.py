"""WARC archives as a PySpark Python data source.

``spark.read.format("warc")`` plans one partition per stretch of an archive
(stretches begin at record starts that the writer noted), takes over filters on
record headers, reads a record's header first, and moves past the payload of a
record that a filter rejects. The option ``payload`` says what is wanted of the
others: ``none`` seeks past every block, ``digest`` reads the payload and
returns its digest and length, ``bytes`` returns it. ``df.write.format("warc")``
writes one archive per task, of which only committed ones are listed for the
reader, so retried and speculative tasks leave no second copy.

Records follow WARC 1.1: a ``response`` holds an HTTP block, a ``revisit`` of
the identical-payload-digest profile holds the HTTP header alone and refers to
its response. Archives ending in ``.gz`` have one member per record.

Paths are opened with ``pyarrow.fs``, so any file system it knows will do.

Defined results: a null page is an empty payload; a null page id is written as
``-`` and read as null, and is never the smallest; equal payloads of the same
page id are all responses (rows repeated as they are); null addresses have no
target; line breaks and control characters in addresses are percent-encoded;
payloads of any length are written whole; an empty table gives no archive and
reads as an empty table; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual,
                                    StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)

from cadence.llm._tables import new_path, ready, stored

SCHEMA = ("page_id bigint, record_type string, target_uri string, payload_digest string, refers_to bigint, "
          "payload_bytes bigint, payload binary")
#: Columns that a record's own headers give; filters on others stay with Spark.
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "refers_to")
#: Bytes between the record starts that the writer notes.
STRETCH = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records --------------------------------------------------------------------------------------

def _clean(uri: str) -> str:
    return "".join(c if c.isprintable() and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in uri)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'-' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    x = (name or "").strip("<>").rpartition(":")[2]
    try:
        return int(x)
    except ValueError:
        return None


def record(page_id: int | None, uri: str | None, kind: str, digest: str, refers_to: int | None, payload: bytes,
           length: int, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


class Cursor:
    """Reads forward; skipping beyond the buffer seeks where the stream can."""

    def __init__(self, stream, start: int = 0, seekable: bool = True, step: int = 1 << 18):
        self.stream, self.seekable, self.step = stream, seekable, step
        self.buffer, self.at, self.position = b"", 0, start
        if start:
            stream.seek(start)

    def _more(self) -> bool:
        new = self.stream.read(self.step)
        self.buffer = self.buffer[self.at:] + new
        self.at = 0
        return bool(new)

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to the mark, which is passed; None at the end."""
        while (i := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out = self.buffer[self.at:i]
        self.position += i + len(mark) - self.at
        self.at = i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = [self.buffer[self.at:self.at + n]]
        have = len(parts[0])
        self.at += have
        while have < n and (new := self.stream.read(n - have)):
            parts.append(new)
            have += len(new)
        self.position += have
        return b"".join(parts)

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buffer) - self.at)
        self.at += inside
        self.position += inside
        rest = n - inside
        if rest and self.seekable:
            self.position += rest
            self.stream.seek(self.position)
        elif rest:
            self.take(rest)


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def records(cursor: Cursor, end: int | None, accepts, payload: str) -> Iterator[tuple]:
    """The rows of a stretch. Of rejected records only the header is read."""
    while end is None or cursor.position < end:
        head = cursor.until(b"\r\n\r\n")
        if head is None:
            return
        h = _headers(head.lstrip(b"\r\n"))
        size = int(h.get("content-length", 0))
        kind = h.get("warc-type")
        row = {"page_id": _id(h.get("warc-record-id")), "record_type": kind, "target_uri": h.get("warc-target-uri"),
               "refers_to": _id(h.get("warc-refers-to")) if kind == "revisit" else None}
        if not accepts(row):
            cursor.skip(size + 4)
            continue
        digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
        after = cursor.position + size
        length, body = size, None
        if h.get("content-type", "").startswith("application/http") and size:
            http = _headers(cursor.until(b"\r\n\r\n") or b"")
            length = after - cursor.position if kind != "revisit" else int(http.get("content-length", 0))
        if payload != "none" and kind != "revisit":
            body = cursor.take(after - cursor.position)
            length, digest = len(body), base32_sha1(body)
        cursor.skip(after + 4 - cursor.position)
        yield (row["page_id"], kind, row["target_uri"], digest, row["refers_to"], length, body if payload == "bytes" else None)


# --- the data source ------------------------------------------------------------------------------

_COMPARE = {
    EqualTo: lambda a, b: a is not None and a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a is not None and a in b,
    GreaterThan: lambda a, b: a is not None and a > b, GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
    LessThan: lambda a, b: a is not None and a < b, LessThanOrEqual: lambda a, b: a is not None and a <= b,
    StringStartsWith: lambda a, b: a is not None and a.startswith(b), StringEndsWith: lambda a, b: a is not None and a.endswith(b),
    StringContains: lambda a, b: a is not None and b in a,
}


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload, self.tests = options["path"], options.get("payload", "none"), []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and type(f) in (IsNull, IsNotNull):
                self.tests.append((name, "null" if type(f) is IsNull else "known", None))
            elif name in HEADER_COLUMNS and type(f) in _COMPARE:
                self.tests.append((name, type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        lists = [x for x in found if x.base_name.startswith("_manifest-")]
        out = []
        if lists:
            for x in lists:
                with fs.open_input_stream(x.path) as f:
                    for name, size, marks in json.loads(f.read()):
                        ends = [*marks[1:], size]
                        out += [Stretch(name, a, None if name.endswith(".gz") else b) for a, b in zip(marks, ends)]
        else:
            out = [Stretch(x.base_name, 0, None) for x in found if x.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Stretch("", 0, 0)]

    def read(self, part):
        by_name = {k.__name__: v for k, v in _COMPARE.items()}

        def accepts(row):
            for name, how, value in self.tests:
                a = row[name]
                if how in ("null", "known"):
                    if (a is None) != (how == "null"):
                        return False
                elif not by_name[how](a, value):
                    return False
            return True

        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        if not part.path:
            return
        fs, path = filesystem(self.path)
        with fs.open_input_file(f"{path}/{part.path}") as f:
            packed = part.path.endswith(".gz")
            cursor = Cursor(gzip.GzipFile(fileobj=f), seekable=False) if packed else Cursor(f, part.start)
            rows, held = [], 0
            for r in records(cursor, part.end, accepts, self.payload):
                rows.append(r)
                held += len(r[6] or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None, size: int, marks: list[int]):
        self.name, self.size, self.marks = name, size, marks


class WarcWriter(DataSourceArrowWriter):
    """Columns: page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload."""

    def __init__(self, options):
        self.path, self.packed = options["path"], options.get("compression", "none") == "gzip"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        name, size, marks, out = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed, 0, [0], None
        try:
            for batch in iterator:
                cols = [batch.column(c) for c in ("page_id", "url", "record_type", "payload_digest", "refers_to", "payload", "payload_bytes")]
                for i in range(batch.num_rows):
                    page_id, uri, kind, digest, refers, payload, length = (c[i].as_py() for c in cols)
                    raw = record(page_id, uri, kind, digest, refers, payload or b"", length, self.date)
                    if self.packed:
                        raw = gzip.compress(raw, 6, mtime=0)
                    if out is None:
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    if not self.packed and size - marks[-1] >= STRETCH:
                        marks.append(size)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, size, marks)

    def commit(self, messages):
        fs, path = filesystem(self.path)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps([[m.name, m.size, m.marks] for m in messages if m and m.name]).encode())

    def abort(self, messages):
        fs, path = filesystem(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{path}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register_source(spark: SparkSession) -> None:
    """Make ``format("warc")`` known; Python sources take filters only if the session says so."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# --- pages ----------------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """The rows that the writer takes: of equal payloads of at least
    ``min_bytes`` bytes, the smallest page id is the response."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    t = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                     F.sha1(payload).alias("sha"))
    first = stored(t.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1").select("sha", "first_id"), "first-pages")
    t = t.join(first.withColumn("known", F.lit(True)), "sha", "left")
    size = F.octet_length("payload")
    again = F.col("known") & (size >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    again = F.coalesce(again, F.lit(False))
    quads = [F.conv(F.substring("sha", 1 + 10 * i, 10), 16, 10).cast("long") for i in range(4)]
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    base32 = F.concat(*[F.substring(letters, (F.shiftright(q, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
                        for q in quads for i in range(8)])
    return t.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"),
                    base32.alias("payload_digest"), F.when(again, F.col("first_id")).alias("refers_to"),
                    size.cast("long").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0, compression: str = "none", **columns) -> str:
    """Write a record per row; returns the folder of the archives."""
    spark = pages.sparkSession
    register_source(spark)
    path = path or new_path(spark, "warc")
    (with_revisits(pages, min_bytes, **columns).write.format("warc").option("path", path)
     .option("compression", compression).mode("append").save())
    return path


def read_records(spark: SparkSession, path: str, digest: bool = False, payload: bool = False) -> DataFrame:
    """The records of the archives in a folder."""
    register_source(spark)
    wanted = "bytes" if payload else "digest" if digest else "none"
    return spark.read.format("warc").option("payload", wanted).load(path)
