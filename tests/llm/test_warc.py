"""WARC round trips, header filters and skipped payloads."""

import io

import pytest
from pyspark.sql import functions as F

from cadence.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, known int"
ROWS = [(1, "http://a/é x", "<p>ü</p>", "s", 1), (2, "http://b", "<p>ü</p>", "s", 1), (3, None, None, "s", 1), (4, "http://d\r\nX: y", "", "s", 1),
        (5, "http://e", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "s", 1), (5, "http://e", "z", "s", 1), (5, "http://e", "z", "s", 1),
        (None, "http://n", "<p>ü</p>", "s", 1), (6, "http://f", "w" * 300_000, "s", 1)]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    path = warc.write_pages(pages, compression=compression)
    got = warc.read_records(spark, path, payload=True).collect()
    first = {}
    for i, _, h, *_ in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 99), i)
    exp = []
    for i, _, h, *_ in ROWS:
        raw = (h or "").encode()
        again = i != first[h or ""]
        exp.append((i, "revisit" if again else "response", warc.base32_sha1(raw), first[h or ""] if again else None, len(raw),
                    None if again else raw))
    assert sorted(map(str, ((r.page_id, r.record_type, r.payload_digest, r.refers_to, r.payload_bytes,
                             None if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(str, exp))
    uris = {r.page_id: r.target_uri for r in got}
    assert uris[3] is None and uris[1] == "http://a/é x" and uris[4] == "http://d%0D%0AX: y"


def test_small_payloads_are_all_responses(spark):
    path = warc.write_pages(spark.createDataFrame(ROWS, SCHEMA), min_bytes=5)
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read_records(spark, path).collect()}
    assert kinds[4, 0] == "response" and kinds[2, 9] == "revisit"


def test_filters_reach_the_reader(spark):
    path = warc.write_pages(spark.createDataFrame(ROWS, SCHEMA))
    t = warc.read_records(spark, path, digest=True)
    assert {r.page_id for r in t.filter((F.col("record_type") == "revisit") & F.col("refers_to").isNotNull()).collect()} == {2, 4, None}
    assert t.filter(F.col("page_id").isin(1, 6) & F.col("target_uri").startswith("http://f")).count() == 1
    assert t.filter("page_id <=> null").count() == 1
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, In

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("payload_bytes",), (1,))]))
    assert len(rest) == 1 and reader.tests == [("record_type", "EqualTo", "revisit")]


def test_rejected_payloads_are_not_read():
    raw = b"".join(warc.record(i, "u", "response", "D", None, b"x" * 1_000_000, 1_000_000, "d") for i in range(6))

    class Counting(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.taken += len(out)
            return out

    rows = list(warc.records(warc.Cursor(Counting(raw), step=4096), len(raw), lambda r: r["page_id"] == 4, "digest"))
    assert [r[0] for r in rows] == [4] and rows[0][5] == 1_000_000
    assert Counting.taken < 1_100_000


def test_empty_table_and_foreign_archive(spark, tmp_path):
    assert warc.read_records(spark, warc.write_pages(spark.createDataFrame([], SCHEMA))).count() == 0
    (tmp_path / "x.warc").write_bytes(
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n" + warc.record(9, "u", "response", "D", None, b"hi", 2, "d"))
    got = warc.read_records(spark, str(tmp_path), payload=True).filter("record_type = 'response'").collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(9, b"hi")]
