"""Scalar column functions (H1-H17) — all JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_us(ts) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ (UTC)."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_seconds(ts) -> Column:
    """H2: date/datetime -> epoch seconds (double, fraction kept)."""
    return epoch_us(ts) / F.lit(1_000_000.0)


def parse_timespan(s) -> Column:
    """H1: ``'H:M:S'`` (float parts) -> duration in seconds (double)."""
    parts = F.split(_c(s), ":")
    h = F.try_element_at(parts, F.lit(1)).try_cast("double")
    m = F.try_element_at(parts, F.lit(2)).try_cast("double")
    sec = F.try_element_at(parts, F.lit(3)).try_cast("double")
    return h * 3600.0 + m * 60.0 + sec


def int_to_code(i) -> Column:
    """H3: integer -> ``'1'`` + 8-bit zero-padded binary (longer from 256 on).

    ``lpad`` alone would truncate to 8 characters, hence the length guard.
    """
    b = F.bin(_c(i).cast("bigint"))
    return F.concat(F.lit("1"), F.when(F.length(b) < 8, F.lpad(b, 8, "0")).otherwise(b))


def code_to_int(s) -> Column:
    """H4: ``'1'+bits`` code -> integer (first character dropped, base 2)."""
    return F.conv(F.substring(_c(s), 2, 1 << 20), 2, 10).cast("bigint")


def epoch_ms_to_ts(ms) -> Column:
    """H6: integer milliseconds -> timestamp."""
    return F.timestamp_millis(_c(ms).cast("bigint"))


def epoch_by_digits(v) -> Column:
    """H7: request epoch; divisor 1000 for 13 digits, 10000 for 14, else 100.

    The quotient is in seconds; it is turned into microseconds with exact
    integer arithmetic (quotient and remainder separately, no overflow).
    """
    x = _c(v).cast("bigint")
    n = F.length(F.abs(x).cast("string"))
    div = F.when(n == 13, 1000).when(n == 14, 10000).otherwise(100).cast("bigint")
    r = F.pmod(x, div)
    q = ((x - r) / div).cast("bigint")
    r6 = r * F.lit(1_000_000)
    frac = ((r6 - F.pmod(r6, div)) / div).cast("bigint")
    return F.timestamp_micros(q * F.lit(1_000_000) + frac)


def date_struct_to_ts(v) -> Column:
    """H7: a struct ``{"$date": milliseconds}`` -> timestamp."""
    return epoch_ms_to_ts(_c(v).getField("$date"))


def escape_feature_name(name: str) -> str:
    """H9: dots in feature names become fullwidth dots."""
    return name.replace(".", "．")


def target_column_name(target: str) -> str:
    """``target_value_<t>``, idempotent."""
    return target if target.startswith("target_value_") else f"target_value_{target}"


def is_phone(s) -> Column:
    """Phone-number predicate over a whole value."""
    return _c(s).rlike(PHONE_PATTERN)


# Phone-number pattern of the reference (whole-value match).
PHONE_PATTERN = r"^\+?(([\(\) \\\/\d]{1,10})(-| )?){2,5}$"


def flatten_json(df: DataFrame, col: str, schema: T.StructType | str, sep: str = ".") -> DataFrame:
    """H8: parse a JSON string column and flatten nested fields to dotted columns."""
    parsed = df.withColumn("__j", F.from_json(F.col(col), schema))
    st = parsed.schema["__j"].dataType

    def walk(prefix: list[str], dtype: T.DataType, path: Column):
        if isinstance(dtype, T.StructType):
            out = []
            for f in dtype.fields:
                out += walk(prefix + [f.name], f.dataType, path.getField(f.name))
            return out
        return [path.alias(sep.join(prefix))]

    cols = walk([col], st, F.col("__j"))
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c != col], *cols)


def flatten_any_json(df: DataFrame, col: str, sep: str = ".") -> DataFrame:
    """H8 without a schema: one aggregate over all rows finds every key that any
    row has (as Variant) and the longest array at each place; nested fields and
    array items become dotted columns. Rows lack what they do not have; texts
    that are no JSON have nulls throughout. A key that holds different kinds is
    a text column.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col))).first()[0] or "VOID"
    kind = re.sub(r"\b(VOID|VARIANT)\b", "STRING", found.replace("OBJECT<", "STRUCT<"))
    if not kind.startswith(("STRUCT", "ARRAY")):
        return df.drop(col)
    parsed = df.withColumn("__j", F.from_json(F.col(col), kind))

    def places(prefix: list[str], dtype: T.DataType, path: Column, out: list) -> list:
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                places([*prefix, f.name], f.dataType, path.getField(f.name), out)
        elif isinstance(dtype, T.ArrayType):
            n = parsed.agg(F.max(F.size(path))).first()[0] or 0
            for i in range(max(n, 0)):
                places([*prefix, str(i)], dtype.elementType, F.get(path, F.lit(i)), out)
        else:
            out.append(path.alias(sep.join(prefix)))
        return out

    cols = places([col], parsed.schema["__j"].dataType, F.col("__j"), [])
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns if c != col], *cols)


def flatten_array(arr) -> Column:
    """Flatten an array of arrays."""
    return F.flatten(_c(arr))
