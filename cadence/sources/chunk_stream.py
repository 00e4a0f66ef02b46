"""A stream over a numbered collection, one chunk of rows a micro-batch.

A Python data source whose offsets are chunk numbers. The collection is the
table that ``ChunkedReader`` wrote: partition ``p`` of it is the file ``part-p``,
whose row numbers begin at ``p << PLACE_BITS``. A micro-batch reads of the files
that hold its chunk only the row groups whose statistics meet its interval; the
driver sees file names and one start per partition.

After a restart from a checkpoint the stream goes on behind the last chunk that
it planned; a batch that had not been finished is read again, row for row.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from cadence.operators.numbering import PLACE_BITS, ROW


class Rows(InputPartition):
    """Row numbers ``lo`` to ``hi`` of a file."""

    def __init__(self, file: str, lo: int, hi: int):
        self.file, self.lo, self.hi = file, lo, hi


class ChunkReader(DataSourceStreamReader):
    def __init__(self, schema, plan: dict):
        self.schema = schema
        self.size, self.rows, self.starts = plan["size"], plan["rows"], plan["starts"]
        self.parts = plan["parts"]
        self.files: dict[int, list[str]] = {}
        for f in plan["files"]:
            self.files.setdefault(int(re.search(r"part-(\d+)-[^/]*$", f).group(1)), []).append(f)
        self.chunks = -(-self.rows // self.size)
        self.next = 0

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def latestOffset(self) -> dict:
        self.next = min(self.next + 1, self.chunks)
        return {"chunk": self.next}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.next = max(self.next, end["chunk"])
        first, stop = start["chunk"] * self.size, min(end["chunk"] * self.size, self.rows)
        out = []
        while first < stop:
            i = bisect_right(self.starts, first) - 1
            until = min(stop, self.starts[i + 1] if i + 1 < len(self.starts) else self.rows)
            base = (self.parts[i] << PLACE_BITS) - self.starts[i]
            out += [Rows(f, base + first, base + until - 1) for f in self.files[self.parts[i]]]
            first = until
        return out

    def commit(self, end: dict) -> None:
        self.next = max(self.next, end["chunk"])

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        url = urlparse(partition.file)
        fs, path = (pafs.LocalFileSystem(), unquote(url.path)) if url.scheme in ("", "file") else \
            pafs.FileSystem.from_uri(partition.file)
        want = to_arrow_schema(self.schema)
        row = pads.field(ROW)
        found = pads.dataset(path, filesystem=fs, format="parquet").scanner(
            columns=want.names, filter=(row >= partition.lo) & (row <= partition.hi))
        for batch in found.to_batches():
            if batch.num_rows:
                yield from pa.Table.from_batches([batch]).cast(want, safe=False).to_batches()


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cadence_chunks"

    def streamReader(self, schema) -> ChunkReader:
        return ChunkReader(schema, json.loads(self.options["plan"]))
