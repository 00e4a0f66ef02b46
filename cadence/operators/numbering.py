"""Dense numbers over a total order, by range partitions.

Spark samples split points from the data itself (``repartitionByRange``), so
values that share a prefix or lie close together spread over all tasks. Each
partition is sorted and written once; a row's place is its partition's start, a
prefix sum over one size per partition, plus its place inside. No window ever
holds more than one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.session import cut_lineage

#: ``monotonically_increasing_id`` keeps the partition above this many bits, the place inside below.
PLACE_BITS = 33
ROW = "__row"


def part_of(row: Column) -> Column:
    return F.shiftright(row, PLACE_BITS)


def place_of(row: Column) -> Column:
    return row.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def range_sorted(df: DataFrame, order_by: list, row_col: str = ROW) -> DataFrame:
    """``df`` in range partitions, sorted and written once to the shared folder,
    with ``row_col``: a number that rises in the order (with gaps between
    partitions). Nulls come first. Rows that tie keep one arbitrary order, the
    written one; a flood of rows that tie in all of ``order_by`` is one partition.
    """
    x = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return cut_lineage(x.withColumn(row_col, F.monotonically_increasing_id()))


def part_starts(table: DataFrame, row_col: str = ROW) -> DataFrame:
    """``(__part, __size, __start)`` of a ``range_sorted`` table: one row per partition."""
    sizes = table.groupBy(part_of(F.col(row_col)).alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0)))


def dense_numbers(df: DataFrame, order_by: list, col: str = "n") -> DataFrame:
    """0-based position ``col`` (long) of each row of ``df`` in the order.

    An empty table stays empty; ties and nulls as in ``range_sorted``.
    """
    table = range_sorted(df, order_by)
    # one row per shuffle partition, so never more than spark.sql.shuffle.partitions rows
    starts = F.broadcast(part_starts(table).select("__part", "__start"))
    at = F.col("__start") + place_of(F.col(ROW))
    return table.withColumn("__part", part_of(F.col(ROW))).join(starts, "__part") \
        .withColumn(col, at.cast("bigint")).drop("__part", "__start", ROW)
