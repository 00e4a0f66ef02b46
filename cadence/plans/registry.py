"""Query registry behind ``queries()`` / ``oracle_sql()``.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` over the given
parquet tables (whole tables, no row caps). The optional SQL is an
independent ANSI formulation DuckDB can run on the same tables; output
columns are aliased identically, floats rounded to 6 places and integers
cast to BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # day/hour/epoch semantics are defined in UTC (the oracle's convention);
    # a caller's session may default to another zone
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
