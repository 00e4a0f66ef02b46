"""Time-constrained target picking — as-of joins.

A target definition::

    {"column": "value",
     "constraints": [{"type": "time", "key": "ts", "after": {"hours": 1}},
                     {"key": "user_id"}]}

* ``after``  — first row (time ascending, lowest id on ties) with equal keys
  and ``ts >= row.ts + shift``; no match -> the row's own value (C1).
* ``before`` — by default the reference behaviour: the EARLIEST row of the
  key group if its ``ts <= row.ts - shift`` (C2 quirk); ``mode="nearest"``
  gives the ordinary backward as-of (latest row with ``ts <= row.ts - shift``).
* keys only — the first row of the key group (C3); no constraints -> own value.

A matched row whose value is null yields null (the match is kept in a
struct so a null value is still a match).

Scale design of the as-of (``asof_join``): probe and build rows are unioned
and cut into ``(keys, time bucket)`` partitions; a running ``last(...,
ignorenulls)`` window over one bucket finds the local match in O(n log n)
without a quadratic frame. Probes with no match inside their bucket take
the head of the next non-empty bucket of their key, found with a window
over a per-bucket summary (one row per key and bucket). No task ever
holds a whole hot key — only one bucket of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import epoch_us, target_column_name
from cadence.plans.sizing import bounded_broadcast
from cadence.session import cut_lineage

DAY_US = 86_400 * 1_000_000


def shift_us(spec: dict) -> int:
    """Shift of a time constraint in microseconds (hours+days+seconds, floats)."""
    secs = 0.0
    for unit, mult in (("hours", 3600.0), ("days", 86400.0), ("seconds", 1.0)):
        if unit in spec:
            secs += float(spec[unit]) * mult
    return int(round(secs * 1_000_000))


def asof_join(probe: DataFrame, build: DataFrame, keys: list[str], probe_t: Column,
              build_t: Column, build_tie: Column, payload: Column,
              direction: str = "forward", bucket_us: int = DAY_US,
              hit_col: str = "__hit", adaptive: bool = True,
              target_rows: int = 2_000_000) -> DataFrame:
    """Attach to every probe row the nearest build row in time.

    ``probe_t``/``build_t`` are epoch-microsecond BIGINT columns; forward
    finds the first build row with ``build_t >= probe_t``, backward the last
    with ``build_t <= probe_t``; among equal times the lowest ``build_tie``
    wins, compared in its own type. ``hit_col`` is a struct ``(t, m)`` with ``m`` = payload,
    or null when nothing matches (a probe without a time matches nothing, a
    build row without one is never matched; null keys equal each other). Probe
    columns are preserved.

    ``adaptive`` slices a hot (keys, bucket) -- more than ``target_rows``
    probe+build rows, e.g. one key holding a third of the data -- into
    equal-width time slices; the bucket id is the struct (bucket, slice),
    still monotone in time, so the stitching is unchanged.
    """
    fwd = direction == "forward"
    pcols = probe.columns
    kexpr = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    kn = [f"__k{i}" for i in range(len(keys))]
    # one struct of all keys: its null fields equal each other, so null keys match across buckets too
    whole = F.struct(F.lit(0).alias("z"), *kn)
    P = probe.select(*kexpr, probe_t.cast("bigint").alias("__t"), F.lit(1).alias("__pr"),
                     F.struct(*[F.col(f"`{c}`") for c in pcols]).alias("__p"))
    B = build.select(*kexpr, build_t.cast("bigint").alias("__t"), F.lit(0).alias("__pr"),
                     build_tie.alias("__tie"), payload.alias("__m")).filter("__t IS NOT NULL")
    P = P.withColumn("__tie", F.lit(None).cast(B.schema["__tie"].dataType))
    P = P.withColumn("__m", F.lit(None).cast(B.schema["__m"].dataType))
    B = B.withColumn("__p", F.lit(None).cast(P.schema["__p"].dataType))
    U = P.unionByName(B).withColumn("__cb", F.floor(F.col("__t") / F.lit(bucket_us)))
    if adaptive:
        hot = U.groupBy(*kn, "__cb").agg(F.count(F.lit(1)).alias("__n")) \
            .filter(F.col("__n") > F.lit(target_rows)) \
            .select(*kn, "__cb", F.greatest(F.floor(F.lit(bucket_us) * F.lit(target_rows) / F.col("__n")),
                                            F.lit(1)).cast("bigint").alias("__w"))
        # at most rows / target_rows entries: materialised, then a checked broadcast
        hot = bounded_broadcast(cut_lineage(hot), 5_000_000)
        U = U.join(hot, on=[*kn, "__cb"], how="left")
        sub = F.when(F.col("__w").isNull(), F.lit(0)).otherwise(
            F.floor((F.col("__t") - F.col("__cb") * F.lit(bucket_us)) / F.col("__w")))
    else:
        sub = F.lit(0)
    U = U.withColumn("__b", F.struct(F.col("__cb").alias("c"), sub.cast("bigint").alias("s"))) \
        .withColumn("__kk", whole).drop("__cb", "__w", *kn)

    # local match inside (keys, bucket)
    if fwd:
        order = [F.col("__t").desc(), F.col("__pr").asc(), F.col("__tie").desc()]
    else:
        order = [F.col("__t").asc(), F.col("__pr").asc(), F.col("__tie").desc()]
    w = Window.partitionBy("__kk", "__b").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.when(F.col("__pr") == 0, F.struct(F.col("__t").alias("t"), F.col("__m").alias("m")))
    L = U.withColumn("__loc", F.last(hit, ignorenulls=True).over(w)).filter(F.col("__pr") == 1)

    # head (forward: earliest) / tail (backward: latest) of each build bucket
    rank = F.struct((F.col("__t") if fwd else -F.col("__t")).alias("a"), F.col("__tie").alias("b"))
    heads = U.filter(F.col("__pr") == 0) \
        .groupBy("__kk", "__b").agg(F.min_by(F.struct(F.col("__t").alias("t"), F.col("__m").alias("m")),
                                          rank).alias("__h"))
    # probe buckets come from the bucketed union without its window (scan +
    # projection), so the big union window is evaluated once
    need = U.filter(F.col("__pr") == 1).select("__kk", "__b").distinct() \
        .withColumn("__h", F.lit(None).cast(heads.schema["__h"].dataType)).withColumn("__f", F.lit(1))
    S = heads.withColumn("__f", F.lit(0)).unionByName(need)
    ob = [F.col("__b").desc() if fwd else F.col("__b").asc(), F.col("__f").desc()]
    wb = Window.partitionBy("__kk").orderBy(*ob).rowsBetween(Window.unboundedPreceding, -1)
    nxt = S.withColumn("__nx", F.last("__h", ignorenulls=True).over(wb)) \
        .filter(F.col("__f") == 1).select("__kk", "__b", "__nx")

    J = L.join(nxt, on=["__kk", "__b"], how="left")
    J = J.withColumn(hit_col, F.when(F.col("__t").isNotNull(), F.coalesce(F.col("__loc"), F.col("__nx"))))
    return J.select(*[F.col("__p").getField(c).alias(c) for c in pcols], hit_col)


def _parse(target: dict):
    eq_keys, time_c = [], None
    for c in target.get("constraints", []) or []:
        if c.get("type") == "time":
            time_c = c          # a later time constraint overwrites an earlier one
        else:
            eq_keys.append(c["key"])
    return eq_keys, time_c


def _small(heads: DataFrame) -> DataFrame:
    """A table with a row per key group, written once and broadcast if its size
    allows it, so that few hot key values do not move the big side."""
    return bounded_broadcast(cut_lineage(heads))


def pick_targets(df: DataFrame, targets: list[dict], id_col: str,
                 mode: str = "reference", bucket_us: int = DAY_US) -> DataFrame:
    """Add ``target_value_<column>`` for each target definition.

    ``id_col`` is the unique tie-break (lowest id wins among equal times and
    for the key-only "first match"). ``mode="nearest"`` switches ``before``
    constraints to the ordinary backward as-of.
    """
    out = df
    for tgt in targets:
        col = tgt["column"]
        name = target_column_name(col)
        eq_keys, tc = _parse(tgt)
        missing = [k for k in eq_keys if k not in df.columns]
        if missing:
            raise ValueError(f"Key(s) {missing} not contained in record")
        if tc is None and not eq_keys:
            out = out.withColumn(name, F.col(col))
            continue
        if tc is None:
            hk = [F.col(k).alias(f"__hk{i}") for i, k in enumerate(eq_keys)]
            first = _small(df.groupBy(*hk).agg(F.min_by(F.struct(F.col(col).alias("v")),
                                                        F.col(id_col)).alias("__f")))
            cond = [F.col(k).eqNullSafe(F.col(f"__hk{i}")) for i, k in enumerate(eq_keys)]
            j = out.join(first, on=cond, how="left")
            out = j.select(*[F.col(f"`{c}`") for c in out.columns],
                           F.col("__f").getField("v").alias(name))
            continue
        tkey = tc["key"]
        after = "after" in tc
        sh = shift_us(tc["after"] if after else tc["before"])
        t = epoch_us(tkey)
        if after or mode == "nearest":
            probe_t = t + F.lit(sh) if after else t - F.lit(sh)
            r = asof_join(out, df, eq_keys, probe_t, t, F.col(id_col),
                          F.struct(F.col(col).alias("v")),
                          direction="forward" if after else "backward", bucket_us=bucket_us)
            out = r.withColumn(name, F.when(F.col("__hit").isNull(), F.col(col))
                               .otherwise(F.col("__hit.m.v"))).drop("__hit")
        else:
            # reference "before": earliest row of the key group, if early enough
            hk = [F.col(k).alias(f"__hk{i}") for i, k in enumerate(eq_keys)]
            head = df.groupBy(*hk).agg(F.min(F.struct(t.alias("t"), F.col(id_col).alias("i"),
                                                      F.col(col).alias("v"))).alias("__e"))
            if eq_keys:
                cond = [F.col(k).eqNullSafe(F.col(f"__hk{i}")) for i, k in enumerate(eq_keys)]
                j = out.join(_small(head), on=cond, how="left")
                j = j.select(*[F.col(f"`{c}`") for c in out.columns], "__e")
            else:
                j = out.crossJoin(F.broadcast(head))      # one-row global head
            ok = F.col("__e.t") <= epoch_us(tkey) - F.lit(sh)
            out = j.withColumn(name, F.when(ok, F.col("__e.v")).otherwise(F.col(col))).drop("__e")
    return out


def init_targets(df: DataFrame, targets: list[str]) -> DataFrame:
    """Zero-initialised ``target_value_*`` columns for absent targets."""
    add = {target_column_name(t): F.lit(0.0) for t in targets
           if target_column_name(t) not in df.columns}
    return df.withColumns(add) if add else df


def split_targets(df: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features without any target column, target values)."""
    tcols = [target_column_name(t) for t in targets]
    drop = set(tcols) | set(targets)
    feats = df.select(*[c for c in df.columns if c not in drop])
    vals = df.select(*[F.col(target_column_name(t)).alias(t) for t in targets
                       if target_column_name(t) in df.columns])
    return feats, vals
