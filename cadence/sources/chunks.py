"""Chunks of a collection in id order.

The collection is range-partitioned by its order and written once with a
rising row number, so that a chunk is one interval of that number: parquet's
row-group statistics leave out the files that do not hold it, and no chunk
needs the chunks before it.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.cleaning import time_range
from cadence.operators.numbering import PLACE_BITS, ROW, part_starts, range_sorted
from cadence.session import ship_package
from cadence.sources.chunk_stream import ChunkSource
from cadence.sources.readers import feature_vectors


class ChunkedReader:
    """Chunks of ``size`` rows of ``df`` in the order of ``order_by``, the last one
    with what is left; every row is in one chunk.

    ``ts``/``start``/``end`` read a half-open time range first. ``order_by`` should be
    a total order; rows that tie keep the order in which they were written. An empty
    collection has no chunk. What reaches the driver is one size per partition.
    """

    def __init__(self, df: DataFrame, order_by: list, size: int = 10_000, ts: str | None = None, start=None, end=None):
        if size < 1:
            raise ValueError("a chunk has at least one row")
        self.size = size
        self.table = range_sorted(df if ts is None else time_range(df, ts, start, end), order_by)
        parts = part_starts(self.table).orderBy("__part").collect()
        self._parts, self._starts = [p["__part"] for p in parts], [p["__start"] for p in parts]
        self.rows = sum(p["__size"] for p in parts)

    def __len__(self) -> int:
        return -(-self.rows // self.size)

    def _row(self, position: int) -> int:
        """The row number at a position of the order."""
        i = bisect_right(self._starts, position) - 1
        return (self._parts[i] << PLACE_BITS) + position - self._starts[i]

    def chunk(self, i: int) -> DataFrame:
        """The rows of chunk ``i`` with the collection's columns."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        lo, hi = self._row(i * self.size), self._row(min(self.rows, (i + 1) * self.size) - 1)
        return self.table.filter(F.col(ROW).between(lo, hi)).orderBy(ROW).drop(ROW)

    def __iter__(self) -> Iterator[DataFrame]:
        """All chunks in order; a new iteration starts again at the first."""
        return (self.chunk(i) for i in range(len(self)))

    def stream(self) -> DataFrame:
        """The collection as a stream that gives one chunk, in order, to each
        micro-batch; columns as in the collection. ``trigger(availableNow=True)``
        ends after one chunk; ``processAllAvailable`` reads to the last."""
        spark = self.table.sparkSession
        ship_package(spark)
        spark.dataSource.register(ChunkSource)
        files = self.table.inputFiles()
        plan = {"files": sorted(files), "parts": self._parts, "starts": self._starts, "rows": self.rows, "size": self.size}
        return spark.readStream.format(ChunkSource.name()).schema(self.table.drop(ROW).schema) \
            .option("plan", json.dumps(plan)).load()

    def vectors(self, cols: list[str], normalize: bool = False) -> Iterator[DataFrame]:
        """The chunks with a feature array, optionally normalised by row."""
        return (feature_vectors(c, cols, normalize) for c in self)
