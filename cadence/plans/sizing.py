"""Size-checked broadcast.

A side is broadcast only after a bounded count proves it is small, in rows
and in bytes; the count stops at ``max_rows + 1`` rows so it never scans more
than that many rows past the filters. Beyond a bound the side is returned
unhinted and Spark plans a shuffle join (AQE may still convert it at
runtime from real shuffle sizes). The side is read for the count and again for
the join, so it should be a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000
#: of the rows as JSON text
DEFAULT_MAX_BROADCAST_BYTES = 256 << 20


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    row = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df
