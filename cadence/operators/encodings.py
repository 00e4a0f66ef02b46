"""Category dictionaries and encodings.

Codes are the reference's ``'1' + 8-bit`` binary strings (H3). A dictionary
is a DataFrame ``(value, n, code)``; dense sequential numbers come from range
partitions of the distinct values, written once (``numbering``); joins against
the dictionary are left to AQE, which broadcasts it from its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions.scalars import code_to_int, int_to_code
from cadence.operators.numbering import dense_numbers


def build_dictionary(df: DataFrame, col: str, offset: int = 0,
                     order_by: str | None = None) -> DataFrame:
    """Number the DISTINCT non-null values (never the rows) from ``offset``.

    Default order is by value; ``order_by`` (e.g. an id or time column)
    numbers values by first appearance instead. Returns ``(value, n, code)``.
    """
    rows = df.filter(F.col(col).isNotNull())
    if order_by:
        vals = rows.groupBy(F.col(col).alias("value")).agg(F.min(order_by).alias("__first"))
        pos = dense_numbers(vals, ["__first", "value"], "__pos")
    else:
        pos = dense_numbers(rows.select(F.col(col).alias("value")).distinct(), ["value"], "__pos")
    n = (F.col("__pos") + F.lit(offset)).cast("bigint")
    return pos.select("value", n.alias("n"), int_to_code(n).alias("code"))


def expand_bits(df: DataFrame, col: str, width: int | None = None) -> DataFrame:
    """``<f>0..`` = the code's bits after the leading '1'; drop ``<f>``.
    Without a ``width`` the longest code gives it (8 at least), so that no bit is lost."""
    if width is None:
        width = max(8, (df.agg(F.max(F.length(col))).first()[0] or 0) - 1)
    bits = {f"{col}{i}": F.substring(F.col(col), i + 2, 1).try_cast("int") for i in range(width)}
    return df.withColumns(bits).drop(col)


def encode(df: DataFrame, col: str, dictionary: DataFrame,
           out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode ``col`` through the dictionary; unseen values get new codes
    numbered after the current maximum. Returns (encoded frame, new dictionary).
    """
    out = out or col
    unseen = df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull()).distinct() \
        .join(dictionary.select("value"), "value", "left_anti")
    nxt = dictionary.agg(F.coalesce(F.max("n") + 1, F.lit(0)).alias("m")).first()["m"]
    extra = build_dictionary(unseen, "value", offset=int(nxt))
    full = dictionary.select("value", "n", "code").unionByName(extra)
    # the dictionary is derived data: AQE broadcasts it from its measured size
    d = full.select(F.col("value").alias("__v"), F.col("code").alias("__code"))
    enc = df.join(d, F.col(col) == F.col("__v"), "left").drop("__v")
    enc = enc.drop(col).withColumnRenamed("__code", out) if out == col else \
        enc.withColumnRenamed("__code", out)
    return enc, full


def decode(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None) -> DataFrame:
    """I4: code (or decoded integer) back to the plain value."""
    out = out or col
    d = dictionary.select(F.col("code").alias("__c"), F.col("value").alias("__val"))
    dec = df.join(d, F.col(col) == F.col("__c"), "left").drop("__c")
    return dec.drop(col).withColumnRenamed("__val", out) if out == col else \
        dec.withColumnRenamed("__val", out)


def decode_int(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Decode declared ``binaryintid`` fields to integers.

    ``fields`` are flags ``{name, encoding}``; only present, declared fields
    are touched; an unknown encoding raises.
    """
    out = {}
    for f in fields:
        enc = (f.get("encoding") or "").lower()
        if not enc or f["name"] not in df.columns:
            continue
        if enc != "binaryintid":
            raise ValueError(f"unknown encoding {enc!r} for {f['name']}")
        out[f["name"]] = code_to_int(F.col(f["name"]).cast("string"))
    return df.withColumns(out) if out else df


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """the ``k`` most frequent non-null values (count desc, value asc)."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), F.col(col)).limit(k)


def one_hot(df: DataFrame, col: str, top_n: int = 10, drop: bool = True) -> DataFrame:
    """One 0/1 column ``<col> = <value>`` per frequent value (top ``top_n``).

    Only the ``top_n`` values (bounded) reach the driver to name the columns.
    """
    vals = [r[col] for r in top_values(df, col, top_n).collect()]
    cols = {f"{col} = {v}": (F.col(col) == F.lit(v)).cast("int") for v in vals}
    out = df.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in cols.items()})
    return out.drop(col) if drop else out


def label_vector(label: Column | str, n_classes: int) -> Column:
    """One-hot label vector of length ``n_classes``."""
    c = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == c, 1).otherwise(0))
