"""Projections, filters and cleaning (B1-B17) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.scalars import target_column_name

# Null tokens of reads and of cleanup (reference vocabularies).
READ_NULL_TOKENS = ["NULL", "null", ""]
CLEANUP_NULL_TOKENS = ["NA", "None", "null", "NULL"]

_FLOATS = (T.FloatType, T.DoubleType)
_TS = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _is(df: DataFrame, c: str, types) -> bool:
    return isinstance(df.schema[c].dataType, types)


def not_null_token(df: DataFrame, c: str) -> Column:
    col = F.col(f"`{c}`")
    if _is(df, c, T.StringType):
        return col.isNotNull() & ~col.isin(*READ_NULL_TOKENS)
    return col.isNotNull()


def drop_null_tokens(df: DataFrame, cols: list[str]) -> DataFrame:
    """B1: keep rows where every listed column exists and is not a null token.

    A listed column that does not exist removes every row (the reference's
    ``$exists`` on a missing field matches nothing).
    """
    if any(c not in df.columns for c in cols):
        return df.filter(F.lit(False))
    cond = F.lit(True)
    for c in cols:
        cond = cond & not_null_token(df, c)
    return df.filter(cond)


def time_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """B2: ``start <= ts < end``, either bound optional (pushed to the scan)."""
    c = F.col(ts)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(c < F.lit(end).cast(df.schema[ts].dataType))
    return df


def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-Inf -> null on float columns."""
    cols = cols or [c for c in df.columns if _is(df, c, _FLOATS)]
    return df.withColumns({c: F.when(F.abs(F.col(c)) == F.lit(math.inf), None)
                           .otherwise(F.col(c)) for c in cols}) if cols else df


def dropna_any(df: DataFrame) -> DataFrame:
    """Drop rows holding any null or NaN."""
    return df.na.drop(how="any")


def drop_roles(df: DataFrame, ids=(), keys=(), targets=()) -> DataFrame:
    """Drop id, key and target columns (raw and ``target_value_`` names)."""
    drop = set(ids) | set(keys)
    for t in targets:
        drop |= {t, target_column_name(t)}
    return df.drop(*[c for c in df.columns if c in drop])


def cleanup_na(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null tokens, null and +-Inf -> 0 (``'0'`` in text columns); NaN kept."""
    cols = cols or df.columns
    out = {}
    for c in cols:
        col = F.col(f"`{c}`")
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            out[c] = F.when(col.isNull() | col.isin(*CLEANUP_NULL_TOKENS), F.lit("0")).otherwise(col)
        elif isinstance(dt, _FLOATS):
            out[c] = F.when(col.isNull() | (F.abs(col) == F.lit(math.inf)), F.lit(0.0)).otherwise(col)
        elif isinstance(dt, T.NumericType):
            out[c] = F.coalesce(col, F.lit(0).cast(dt))
    return df.withColumns(out) if out else df


def expand_datetime(df: DataFrame, cols: list[str] | None = None, deconstruct: bool = True) -> DataFrame:
    """``<f>_year/_month/_day/_hour/_minute`` then drop ``<f>``."""
    if not deconstruct:
        return df
    cols = cols or [c for c in df.columns if _is(df, c, _TS)]
    for c in cols:
        x = F.col(c)
        df = df.withColumns({f"{c}_year": F.year(x), f"{c}_month": F.month(x),
                             f"{c}_day": F.dayofmonth(x), f"{c}_hour": F.hour(x),
                             f"{c}_minute": F.minute(x)}).drop(c)
    return df


# type names of the reference's format maps -> Spark types
TYPE_NAMES = {"int": "bigint", "int64": "bigint", "float": "double", "float64": "double",
              "str": "string", "string": "string", "datetime": "timestamp", "bool": "boolean",
              "double": "double", "bigint": "bigint", "timestamp": "timestamp"}


def cast_fields(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Per-field ``try_cast`` by a format map; absent columns ignored."""
    out = {c: F.col(c).try_cast(TYPE_NAMES.get(t, t)) for c, t in formats.items() if c in df.columns}
    return df.withColumns(out) if out else df


def nan_to_num(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NaN -> 0, +Inf -> max finite, -Inf -> -max finite (null -> 0)."""
    big = 1.7976931348623157e308
    cols = cols or [c for c in df.columns if _is(df, c, T.NumericType)]
    out = {}
    for c in cols:
        x = F.col(c).cast("double")
        out[c] = (F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                  .when(x == F.lit(math.inf), F.lit(big))
                  .when(x == F.lit(-math.inf), F.lit(-big)).otherwise(x))
    return df.withColumns(out) if out else df


def impute_mean(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop all-null numeric columns, fill the rest's nulls with the mean.

    One aggregate pass yields a single row (two numbers per column) — the
    only thing brought to the driver.
    """
    cols = cols or [c for c in df.columns if _is(df, c, T.NumericType)]
    if not cols:
        return df
    q = lambda c: F.col(f"`{c}`")  # noqa: E731  (generated names may hold dots)
    stats = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    empty = [c for i, c in enumerate(cols) if stats[f"n{i}"] == 0]
    fills = {c: F.coalesce(q(c), F.lit(stats[f"m{i}"]).cast(df.schema[c].dataType))
             for i, c in enumerate(cols) if c not in empty}
    return df.drop(*empty).withColumns(fills)


def tail_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The last ``n`` rows in the order (the padding rows); TakeOrdered."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns absent from the frame (metadata only)."""
    return [c for c in required if c not in df.columns]


def feature_values(df: DataFrame, names: list[str], col: str = "features") -> DataFrame:
    """Feature vector in a fixed order, missing column/value -> 0."""
    vals = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
            for n in names]
    return df.withColumn(col, F.array(*vals))


def drop_other_targets(df: DataFrame, target: str, all_targets: list[str]) -> DataFrame:
    """Drop sibling ``target_value_*`` columns before per-target work."""
    drop = [target_column_name(t) for t in all_targets if t != target]
    return df.drop(*[c for c in drop if c in df.columns])
