"""Set operations, distinct and per-key top-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_keys(df: DataFrame, key: str, cond: Column | None = None) -> DataFrame:
    """G1: distinct key values under a filter (partial aggregation map-side)."""
    if cond is not None:
        df = df.filter(cond)
    return df.select(key).distinct()


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys present in both inputs (set intersection)."""
    return a.select(key).intersect(b.select(key))


def normalize_entity(df: DataFrame, index: str, extra: list[str], order_by: list[str]) -> DataFrame:
    """One parent row per distinct index, its extra columns taken from the
    first row in ``order_by`` (a deterministic ``dropDuplicates``)."""
    pick = F.min_by(F.struct(*extra), F.struct(*order_by)).alias("__e")
    return df.groupBy(index).agg(pick).select(index, *[F.col(f"__e.{c}").alias(c) for c in extra])


def top1(df: DataFrame, keys: list[str], order_by: list[Column], cols: list[str]) -> DataFrame:
    """per key, the row first in ``order_by`` (``min_by`` over the order
    struct: one partial aggregate, no sort of the whole key group)."""
    pick = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*order_by)).alias("__t")
    return df.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"__t.{c}").alias(c) for c in cols])
