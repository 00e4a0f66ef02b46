"""Written intermediate tables in the shared folder of the cluster.

Every lineage cut of this subpackage is a Parquet table below
``spark.checkpoint.dir``: a lost executor never takes part of it along, and
both sides of a later join start at a plain scan, so that adaptive execution
may split a hot key on either side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadence.session import scratch_path, ship_package


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return scratch_path(spark, f"llm-{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
