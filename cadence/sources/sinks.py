"""Sinks (A11-A14): raw append, feature-group records, upsert, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_raw(df: DataFrame, path: str, id_col: str = "_id", fmt: str = "parquet",
               partition_by: list[str] | None = None) -> None:
    """Append records, assigning a unique id when absent.

    ``monotonically_increasing_id`` is unique per write; with an existing id
    column the records are written as they are.
    """
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.monotonically_increasing_id())
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def feature_group_records(features: DataFrame, targets: list[str], group_keys: list[str],
                          ts_col: str = "_ts", member_col: str | None = None,
                          meta_exclude: tuple[str, ...] = ("run_id", "n_elements", "first_id", "last_id")
                          ) -> DataFrame:
    """The nested feature-group record ``{_meta:{_t,_g}, _did, _ts, <features>}``.

    ``_g`` is a string map of the group's key values; ``_did`` is included
    only when the member-id column was computed (bounded runs).
    """
    g = F.create_map(*[x for k in group_keys for x in (F.lit(k), F.col(k).cast("string"))]) \
        if group_keys else F.create_map().cast("map<string,string>")
    meta = F.struct(F.array(*[F.lit(t) for t in targets]).alias("_t"), g.alias("_g"))
    feats = [c for c in features.columns
             if c not in set(group_keys) | {ts_col} | set(meta_exclude) and c != member_col]
    cols = [meta.alias("_meta")]
    if member_col:
        cols.append(F.col(member_col).alias("_did"))
    cols += [F.col(ts_col).alias("_ts"), *[F.col(f"`{c}`") for c in feats]]
    return features.select(*cols)


def write_feature_groups(records: DataFrame, path: str) -> None:
    records.write.mode("append").parquet(path)


def upsert_latest(base: DataFrame, updates: DataFrame, keys: list[str],
                  version_col: str | None = None) -> DataFrame:
    """Keyed upsert — per key, the update wins over the base; among
    several candidates the highest ``version_col`` (then the update) wins.

    Implemented as union + ``max_by`` aggregate (partial aggregation, so a hot
    key is reduced map-side instead of landing whole in one window task).
    ``DataFrame.mergeInto`` can replace this on table formats with MERGE.
    """
    cols = base.columns
    b = base.withColumn("__src", F.lit(0))
    u = updates.select(*cols).withColumn("__src", F.lit(1))
    allr = b.unionByName(u)
    rank = F.struct(*([F.col(version_col)] if version_col else []), F.col("__src"))
    payload = F.struct(*[F.col(f"`{c}`") for c in cols if c not in keys])
    agg = allr.groupBy(*keys).agg(F.max_by(payload, rank).alias("__v"))
    return agg.select(*keys, *[F.col("__v").getField(c).alias(c) for c in cols if c not in keys])


def export_csv(df: DataFrame, path: str) -> None:
    """Feature matrix to CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)
