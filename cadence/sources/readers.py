"""Sources (A1-A10, A15): file / object-store / collection / frame readers.

All readers return lazy DataFrames; cleaning steps are column expressions so
filters and projections still reach the parquet/CSV scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.cleaning import drop_null_tokens, dropna_any, inf_to_null, time_range


def read_file(spark: SparkSession, path: str, fmt: str | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """A1: file source; ±Inf -> null, then rows with any null dropped."""
    fmt = fmt or path.rsplit(".", 1)[-1].lower()
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        df = r.option("header", True).option("inferSchema", schema is None).csv(path)
    elif fmt == "json":
        df = r.json(path)
    else:
        df = r.format(fmt).load(path)
    return dropna_any(inf_to_null(df))


def read_object_store(spark: SparkSession, uri: str, max_rows: int | None = None,
                      schema=None) -> DataFrame:
    """A2: ``s3a://``-style source: CSV and JSON are read whole, unless the
    caller sets ``max_rows`` for a CSV; same cleaning."""
    fmt = uri.rsplit(".", 1)[-1].lower()
    r = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        df = r.option("header", True).option("inferSchema", schema is None).csv(uri)
        df = df if max_rows is None else df.limit(max_rows)
    else:
        df = r.json(uri)
    return dropna_any(inf_to_null(df))


def read_collection(spark: SparkSession, name_or_path: str, fields: list[str | dict] | None = None,
                    id_col: str = "_id", fmt: str = "parquet", dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """A3: a stored collection (catalog table or parquet path).

    Rows with a null token in any (declared) field are dropped, the id column
    is removed, then ±Inf -> null and rows with nulls dropped. ``fields`` are
    names or flags ``{name, encoding}``; a field with the encoding
    ``binaryintid`` becomes the bits of its code (A15): of its dictionary's
    code if ``dictionaries`` has one for it, else of the code it holds.
    """
    # a path has a slash or a scheme; anything else, dots included, is a catalog name
    if "/" in name_or_path or ":" in name_or_path:
        df = spark.read.format(fmt).load(name_or_path)
    else:
        df = spark.table(name_or_path)
    flags = [{"name": f} if isinstance(f, str) else f for f in fields or []]
    cols = [f["name"] for f in flags] or [c for c in df.columns if c != id_col]
    df = drop_null_tokens(df, cols)
    if id_col in df.columns:
        df = df.drop(id_col)
    return encode_fields(dropna_any(inf_to_null(df)), flags, dictionaries)


def encode_fields(df: DataFrame, fields: list[dict], dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """Expand the fields whose flags name an encoding into bit columns."""
    from cadence.operators import encodings

    for f in fields:
        kind = (f.get("encoding") or "").lower()
        if not kind or f["name"] not in df.columns:
            continue
        if kind != "binaryintid":
            raise ValueError(f"unknown encoding {kind!r} for {f['name']}")
        if dictionaries and f["name"] in dictionaries:
            df, _ = encodings.encode(df, f["name"], dictionaries[f["name"]])
        df = encodings.expand_bits(df, f["name"])
    return df


def read_frame(spark: SparkSession, frame) -> DataFrame:
    """A4: an in-memory frame (DataFrame passes through; pandas via Arrow)."""
    if isinstance(frame, DataFrame):
        return frame
    return spark.createDataFrame(frame)


# A5: registry of readers by type name
SOURCES: dict[str, Callable[..., DataFrame]] = {
    "file": read_file,
    "s3": read_object_store,
    "collection": read_collection,
    "pandas": read_frame,
    "frame": read_frame,
}


def read_source(spark: SparkSession, kind: str, target, **opts) -> DataFrame:
    if kind not in SOURCES:
        raise ValueError(f"unknown source type {kind!r}; known: {sorted(SOURCES)}")
    return SOURCES[kind](spark, target, **opts)


def sample_key(id_col: str | Column, seed: int = 0) -> Column:
    """Deterministic pseudo-random order key of a row id of any type: the first
    60 bits of ``md5(id ':' seed)``, which other engines compute as well."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def bounded_read(df: DataFrame, fields: list[str] | None = None, ts: str | None = None,
                 start=None, end=None, sample: int | None = None, limit: int | None = None,
                 id_col: str | None = None, exclude_id: bool = True, seed: int = 0,
                 steps: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """A6 (+A8 via ``limit``): half-open time range, null-token filter on the
    declared fields, optional seeded sample of ``sample`` rows, limit, id drop
    and caller steps — in that order, filters first so they push down."""
    if ts is not None:
        df = time_range(df, ts, start, end)
    if fields:
        df = drop_null_tokens(df, fields)
        keep = list(dict.fromkeys(([id_col] if id_col else []) + fields + ([ts] if ts else [])))
        df = df.select(*[c for c in keep if c in df.columns])
    if sample:
        if not id_col:
            raise ValueError("sampling needs id_col for a reproducible order")
        df = df.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(sample)
    if limit:
        df = df.limit(limit)
    if exclude_id and id_col and id_col in df.columns:
        df = df.drop(id_col)
    for step in steps or []:
        df = df.transform(step)
    return df


def sample_rows(df: DataFrame, cols: list[str], n: int = 100, id_col: str = "id",
                seed: int = 0) -> DataFrame:
    """``n`` pseudo-random rows whose chosen columns are all non-null-token.

    TakeOrdered keeps ``n`` rows per partition before the final merge, so the
    cost is one scan whatever the table size.
    """
    x = drop_null_tokens(df, cols).select(id_col, *[c for c in cols if c != id_col])
    return x.orderBy(sample_key(id_col, seed), F.col(id_col)).limit(n)


def feature_vectors(df: DataFrame, cols: list[str], normalize: bool = False,
                    out: str = "features") -> DataFrame:
    """Project a feature list into an array, optional row L2 normalise."""
    arr = F.array(*[F.col(c).cast("double") for c in cols])
    x = df.withColumn(out, arr)
    if normalize:
        x = x.withColumn(out, l2_normalize(F.col(out)))
    return x


def l2_normalize(arr: Column) -> Column:
    """Row-wise L2 normalisation of an array column (zero vector stays zero)."""
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    return F.transform(arr, lambda v: F.when(norm > 0, v.cast("double") / norm).otherwise(F.lit(0.0)))
