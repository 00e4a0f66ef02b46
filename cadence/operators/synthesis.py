"""Deep feature synthesis over parent/child entities (L1) and training-set
assembly (L3).

Feature generation is metadata: for each FK edge the child's columns get a
list of aggregate expressions; execution is two ``groupBy(fk).agg(...)`` per
edge (``roll_up``: counts, and numbers) and one join to the parent. Deeper
edges are rolled up first (grandchild -> child -> parent), so no level ever
sees raw rows of another.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators import cleaning as B
from cadence.operators.encodings import one_hot
from cadence.operators.targets import split_targets
from cadence.plans.sizing import bounded_broadcast
from cadence.session import cut_lineage

_TS = (T.TimestampType, T.TimestampNTZType, T.DateType)
HOT_ROWS = 1_000_000


@dataclass
class Entity:
    name: str
    df: DataFrame
    index: str
    children: list[tuple["Entity", str]] = field(default_factory=list)   # (child, fk in child)

    def add_child(self, child: "Entity", fk: str) -> "Entity":
        self.children.append((child, fk))
        return self


def _agg_exprs(df: DataFrame, prefix: str, skip: set[str]):
    """The aggregates of ``df``'s columns: their titles in order, those over numbers, and the counts."""
    titles, values, counts = [], [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        nm = f"{prefix}.{f.name}"
        if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType):
            v = c.cast("double")
            found = {f"SUM({nm})": F.sum(v), f"MEAN({nm})": F.avg(v), f"MAX({nm})": F.max(v), f"MIN({nm})": F.min(v),
                     f"STD({nm})": F.stddev_samp(v)}
            values += [e.alias(t) for t, e in found.items()]
            titles += found
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            titles.append(f"NUM_UNIQUE({nm})")
            counts.append(F.count_distinct(c).alias(titles[-1]))
    titles.append(f"COUNT({prefix})")
    return titles, values, [*counts, F.count(F.lit(1)).alias(titles[-1])]


def roll_up(df: DataFrame, fk: str, prefix: str, skip: set[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per value of ``fk`` (as ``__fk``, nulls left out) with the
    aggregates of ``df``'s columns but ``skip``.

    Counts and the aggregates of numbers are grouped apart: distinct counts
    multiply the rows that are shuffled, and the numbers' buffers (eight values a
    column) are wider than a row. So the rows themselves are shuffled by key and
    aggregated where they arrive. Only a key of more than ``hot_rows`` rows, too many for
    one task, is put together from partial aggregates. ``df`` is read twice.
    """
    titles, values, counts = _agg_exprs(df, prefix, skip | {fk})
    x = df.withColumn("__fk", F.col(f"`{fk}`")).filter(F.col("__fk").isNotNull())
    rolled = x.groupBy("__fk").agg(*counts)
    if values:
        rolled = cut_lineage(rolled)
        hot = rolled.filter(F.col(f"`{titles[-1]}`") > hot_rows).select("__fk")
        if hot.isEmpty():
            numbers = x.repartition("__fk").groupBy("__fk").agg(*values)
        else:
            hot = bounded_broadcast(cut_lineage(hot))
            numbers = x.join(hot, "__fk", "left_anti").repartition("__fk").groupBy("__fk").agg(*values) \
                .unionByName(x.join(hot, "__fk", "left_semi").groupBy("__fk").agg(*values))
        rolled = rolled.join(numbers, "__fk")
    return rolled.select("__fk", *[F.col(f"`{t}`") for t in titles])


def _datetime_transforms(df: DataFrame, skip: set[str]) -> DataFrame:
    adds = {}
    for f in df.schema.fields:
        if f.name not in skip and isinstance(f.dataType, _TS):
            c = F.col(f.name)
            adds.update({f"DAY({f.name})": F.dayofmonth(c), f"YEAR({f.name})": F.year(c),
                         f"MONTH({f.name})": F.month(c), f"WEEKDAY({f.name})": F.weekday(c)})
    return df.withColumns(adds) if adds else df


def synthesize(entity: Entity, depth: int = 2) -> DataFrame:
    """Parent rows with aggregate features of every child subtree up to ``depth``."""
    df = _datetime_transforms(entity.df, {entity.index})
    if depth <= 0:
        return df
    for child, fk in entity.children:
        cdf = synthesize(child, depth - 1)
        if depth > 1 and child.children:
            cdf = cut_lineage(cdf)
        rolled = roll_up(cdf, fk, child.name, {child.index})
        df = df.join(rolled, F.col(entity.index) == F.col("__fk"), "left").drop("__fk")
        cnt = f"COUNT({child.name})"
        df = df.withColumn(cnt, F.coalesce(F.col(f"`{cnt}`"), F.lit(0)))
    return df


def deep_features(entity: Entity, depth: int = 2, encode: list[str] | None = None,
                  top_n: int = 10) -> DataFrame:
    """L1 end to end: synthesise, one-hot frequent categories, drop all-null
    columns and mean-impute the rest."""
    # the synthesised table (one row per parent) is read by the imputation
    # statistics and by the output: materialise it once in the shared folder
    df = cut_lineage(synthesize(entity, depth))
    for c in encode or []:
        df = one_hot(df, c, top_n=top_n)
    return B.impute_mean(df)


def training_set(df: DataFrame, targets: list[str], ids=(), keys=(), fields=None,
                 ts=None, start=None, end=None, deconstruct: bool = True):
    """L3: bounded read -> drop nulls -> drop ids/keys -> cleanup -> datetime
    expansion -> (features, target values)."""
    if ts is not None:
        df = B.time_range(df, ts, start, end)
    if fields:
        df = B.drop_null_tokens(df, fields)
    df = B.dropna_any(df)
    df = B.drop_roles(df, ids=ids, keys=keys)
    df = B.cleanup_na(df)
    df = B.expand_datetime(df, deconstruct=deconstruct)
    full = df.withColumns({f"target_value_{t}": F.col(t) for t in targets})
    feats, vals = split_targets(full, targets)
    return feats, vals, full
