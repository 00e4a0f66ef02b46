"""Keyed lookups, caches, monitoring and quotas (C4-C10) as set-oriented joins.

The reference looks records up one at a time; here every lookup is one join
over the whole request set. Sides are never hinted blindly: AQE converts a
join to broadcast only from measured shuffle sizes, and ``bounded_broadcast``
is used where a side is small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadence.functions.scalars import epoch_us

HOUR_US = 3_600 * 1_000_000


def enrich_by_id(inputs: DataFrame, base: DataFrame, id_col: str, base_id: str | None = None,
                 known_fields: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """C4: partial inputs (holding fields outside ``known_fields``, or too few)
    are replaced by the stored record with their id; complete inputs pass.
    ``keep`` names request columns carried along (e.g. a request key).

    Raises when the inputs carry no id column. Unmatched partial inputs drop.
    """
    base_id = base_id or id_col
    if id_col not in inputs.columns:
        raise ValueError(f"partial input needs the `{id_col}` key field")
    known = set(known_fields or base.columns)
    partial = any(c not in known for c in inputs.columns) or set(inputs.columns) != known
    if not partial:
        return inputs
    b = base.withColumnRenamed(base_id, "__bid") if base_id != id_col else \
        base.withColumnRenamed(id_col, "__bid")
    keep = [c for c in (keep or []) if c != id_col]
    j = inputs.select(F.col(id_col).alias("__rid"), *[F.col(c).alias(f"__keep_{c}") for c in keep]) \
        .join(b, F.col("__rid") == F.col("__bid"), "inner")
    return j.select(*[F.col(f"__keep_{c}").alias(c) for c in keep], F.col("__rid").alias(id_col),
                    *[F.col(f"`{c}`") for c in b.columns if c != "__bid"])


def lookup_features(requests: DataFrame, features: DataFrame, req_id: str, targets: list[str],
                    mode: str = "any", members: str = "_did", meta: str = "_meta") -> DataFrame:
    """Stored feature rows containing any requested member id and whose
    target list contains any (``mode='any'``, ``$in``) or all (``'all'``,
    ``$all``) of ``targets``. Each matching feature row is returned once.
    """
    t = F.col(f"{meta}._t")
    want = F.array(*[F.lit(x) for x in targets])
    if mode == "all":
        cond = F.size(F.array_except(want, t)) == 0
    else:
        cond = F.arrays_overlap(t, want)
    fr = features.filter(cond)
    # a record is known by its members' digest, so that a run of n members ships
    # n keys of one size and not n copies of all members
    fr = fr.withColumn("__key", F.sha2(F.to_json(F.array(members)), 256))
    ex = fr.select("__key", F.explode(members).alias("__mid"))
    req = requests.select(F.col(req_id).alias("__mid")).distinct()
    hit = ex.join(req, "__mid", "left_semi").select("__key").distinct()
    return fr.join(hit, "__key", "left_semi").drop("__key")


def split_cached(df: DataFrame, cache: DataFrame, keys: list[str], value_col: str,
                 out: str = "cached", sentinel: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """(all rows with cached value or ``sentinel``, rows to score).

    The cache is reduced to one value per key first (highest value wins on
    duplicates) so the join cannot fan out.
    """
    c = cache.groupBy(*keys).agg(F.max(value_col).alias("__cv"))
    with_cache = df.join(c, on=keys, how="left") \
        .withColumn(out, F.coalesce(F.col("__cv").cast("double"), F.lit(sentinel))).drop("__cv")
    misses = df.join(c.select(*keys), on=keys, how="left_anti")
    return with_cache, misses


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: Column, right_t: Column,
              lo_us: int, hi_us: int) -> DataFrame:
    """Pairs with equal keys and ``left_t - hi < right_t < left_t - lo`` (strict).

    Both sides are bucketed by the band width; each left row probes only the
    (at most two) buckets its band touches, so the join is an equi-join on
    ``(keys, bucket)`` and never forms pairs outside the band.
    """
    width = hi_us - lo_us
    L = left.withColumn("__lt", left_t.cast("bigint"))
    L = L.withColumn("__bk", F.array_distinct(F.array(
        F.floor((F.col("__lt") - F.lit(hi_us)) / F.lit(width)),
        F.floor((F.col("__lt") - F.lit(lo_us)) / F.lit(width)))))
    L = L.withColumn("__bk", F.explode("__bk"))
    R = right.withColumn("__rt", right_t.cast("bigint")) \
        .withColumn("__bk", F.floor(F.col("__rt") / F.lit(width)))
    j = L.join(R, on=[*keys, "__bk"], how="inner")
    return j.filter((F.col("__rt") > F.col("__lt") - F.lit(hi_us)) &
                    (F.col("__rt") < F.col("__lt") - F.lit(lo_us))).drop("__bk")


def _shr(c: Column, k: Column) -> Column:
    return F.call_function("shiftright", c, k)


def _pow2(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k)


def monitor_predictions(pred: DataFrame, act: DataFrame, keys: list[str], ts: str = "ts",
                        value: str = "value", id_col: str = "id", lo_hours: float = 1.0,
                        hi_hours: float = 2.0, threshold: float = 400.0,
                        leaf_bits: int = 20) -> DataFrame:
    """For each actual, the newest prediction strictly 1h-2h older whose
    squared error exceeds ``threshold`` (the first alert when scanning
    newest-first). Returns ``(act_id, pred_id, predicted, actual, score)``.

    No (actual, prediction) pairs are formed inside the band. The band
    (integer microseconds) is cut into two edge leaves of ``2**leaf_bits`` us
    and a run of whole leaves; that run is covered by its canonical dyadic
    blocks (at most two per level). Every prediction is filed under its block
    at each level, and "newest prediction in a block with value above
    ``actual + r`` (or below ``actual - r``)" is a running max over the block
    ordered by value -- an as-of lookup on the value axis. Only the two edge
    leaves are matched pairwise with the exact band filter, so the work is
    linear in both sides times the number of levels, however dense a key is.
    """
    lo_us, hi_us = int(lo_hours * HOUR_US), int(hi_hours * HOUR_US)
    radius = float(threshold) ** 0.5
    a = act.select(*keys, F.col(id_col).alias("act_id"), epoch_us(ts).cast("bigint").alias("__at"),
                   F.col(value).cast("double").alias("actual"))
    a = a.withColumn("__lo", F.col("__at") - F.lit(hi_us - 1)) \
         .withColumn("__hi", F.col("__at") - F.lit(lo_us + 1))
    p = pred.select(*keys, F.col(id_col).alias("pred_id"), epoch_us(ts).cast("bigint").alias("__pt"),
                    F.col(value).cast("double").alias("predicted"))
    cand = F.struct(F.col("__pt").alias("t"), F.col("pred_id").alias("i"), F.col("predicted").alias("v"))

    # Edge leaves: exact band filter on pairs sharing a ~1 s leaf with a band end.
    leaf = lambda c: F.shiftright(c, leaf_bits)
    edges = a.withColumn("__leaf", F.explode(F.array_distinct(F.array(leaf(F.col("__lo")),
                                                                      leaf(F.col("__hi"))))))
    pe = p.withColumn("__leaf", leaf(F.col("__pt")))
    edge_hits = edges.join(pe, on=[*keys, "__leaf"]) \
        .filter(F.col("__pt").between(F.col("__lo"), F.col("__hi")) &
                (((F.col("predicted") - F.col("actual")) ** 2) > F.lit(threshold))) \
        .select("act_id", "actual", cand.alias("c"))

    # Interior whole leaves [first, last] -> canonical dyadic blocks.
    levels = max(1, (hi_us - lo_us).bit_length() - leaf_bits + 1)
    first, last = leaf(F.col("__lo")) + 1, leaf(F.col("__hi")) - 1
    probes = a.withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    k = F.col("__lv")
    lft = _shr(F.col("__first") + _pow2(k) - 1, k)
    rgt = _shr(F.col("__last") + 1, k) - 1
    probes = probes.withColumn("__first", first).withColumn("__last", last) \
        .withColumn("__blk", F.explode(F.array_distinct(F.array(lft, rgt)))) \
        .filter(F.col("__blk").between(lft, rgt))
    # keep a block only when its parent block is not wholly inside the run
    k1 = k + 1
    plft = _shr(F.col("__first") + _pow2(k1) - 1, k1)
    prgt = _shr(F.col("__last") + 1, k1) - 1
    parent = F.shiftright(F.col("__blk"), 1)
    probes = probes.filter(~parent.between(plft, prgt) | (k == F.lit(levels)))
    probes = probes.select(*keys, "act_id", "actual", "__lv", "__blk")

    pl = p.withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(levels)))) \
        .withColumn("__blk", _shr(leaf(F.col("__pt")), F.col("__lv")))

    # One shuffle of probes + filed predictions by block; two orders over it:
    # value descending finds the newest with v > a + r, ascending v < a - r.
    act_type = a.schema["act_id"].dataType.simpleString()
    cand_type = p.select(cand.alias("c")).schema["c"].dataType.simpleString()
    pr = probes.select(*keys, "__lv", "__blk", (F.col("actual") + F.lit(radius)).alias("__vu"),
                       (F.col("actual") - F.lit(radius)).alias("__vd"), F.lit(1).alias("__q"),
                       "act_id", "actual", F.lit(None).cast(cand_type).alias("c"))
    pp = pl.select(*keys, "__lv", "__blk", F.col("predicted").alias("__vu"), F.col("predicted").alias("__vd"),
                   F.lit(0).alias("__q"), F.lit(None).cast(act_type).alias("act_id"),
                   F.lit(None).cast("double").alias("actual"), cand.alias("c"))
    blk = Window.partitionBy(*keys, "__lv", "__blk")
    run = (Window.unboundedPreceding, Window.currentRow)
    up = blk.orderBy(F.col("__vu").desc(), F.col("__q").desc()).rowsBetween(*run)
    dn = blk.orderBy(F.col("__vd").asc(), F.col("__q").desc()).rowsBetween(*run)
    found = pr.unionByName(pp) \
        .withColumn("__cu", F.max("c").over(up)).withColumn("__cd", F.max("c").over(dn)) \
        .filter(F.col("__q") == 1) \
        .select("act_id", "actual", F.greatest("__cu", "__cd").alias("c")).filter(F.col("c").isNotNull())
    hits = edge_hits.unionByName(found)
    best = hits.groupBy("act_id").agg(F.max("c").alias("c"), F.max("actual").alias("actual"))
    out = best.select("act_id", F.col("c.i").alias("pred_id"), F.col("c.v").alias("predicted"), "actual")
    out = out.withColumn("score", (F.col("predicted") - F.col("actual")) ** 2)
    return out.filter(F.col("score") > F.lit(threshold))


def relate(parent: DataFrame, child_agg: DataFrame, pk: str, fk: str, how: str = "left") -> DataFrame:
    """Attach an (already aggregated) child entity to its parent on FK."""
    c = child_agg.withColumnRenamed(fk, "__fk")
    return parent.join(c, F.col(pk) == F.col("__fk"), how).drop("__fk")


def quota_check(usage: DataFrame, limits: DataFrame, user: str,
                periods=("daily", "weekly", "monthly")) -> DataFrame:
    """A user is allowed when every period's usage is <= its limit."""
    lim = limits.select(F.col(user).alias("__u"), *[F.col(f"{p}_limit") for p in periods])
    j = usage.join(lim, F.col(user) == F.col("__u"), "inner").drop("__u")
    ok = F.lit(True)
    for p in periods:
        ok = ok & (F.col(f"{p}_usage") <= F.col(f"{p}_limit"))
    return j.withColumn("allowed", ok)
