"""Consecutive runs and per-run features (E1-E8, D-function host).

A *run* is a maximal stretch of consecutive rows (in an explicit order) that
share the same key values; the same key later starts a NEW run.

Scale design (no global single-partition window): rows are split into
order-contiguous buckets (``date_trunc(unit, ts)`` by default, or any
Column that is monotone in the order). Inside each ``(partition_by, bucket)``
a windowed ``lag`` + running ``sum`` numbers the local runs; a small summary
(one row per bucket: first key, last key, local run count) is stitched with
a window over buckets only, and joined back on ``(partition_by, bucket)``.
The big side keeps the hash partitioning it got for the local window, so the
join-back shuffles only the summary. A hot key or hot user is split across
buckets, so no single task owns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.features import Mergeable, compile_features, mergeable_features
from cadence.operators.numbering import dense_numbers

_B = "__bucket"
_PK = "__pk"


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in (names or [])]


def _bucket_expr(df: DataFrame, order_by, bucket) -> Column:
    if isinstance(bucket, Column):
        return bucket
    first = order_by[0]
    name = first if isinstance(first, str) else None
    if name is not None:
        dtype = df.schema[name].dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.date_trunc(bucket or "hour", F.col(name))
        if isinstance(dtype, T.NumericType):
            width = 100_000 if bucket is None or isinstance(bucket, str) else int(bucket)
            return F.floor(F.col(name) / F.lit(width))
    raise ValueError("pass bucket=<Column monotone in the order> for this order column")


_UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000,
            "week": 7 * 86_400_000_000}


def with_bucket(df: DataFrame, order_by, bucket, partition_by=None,
                target_rows: int = 2_000_000) -> DataFrame:
    """Attach the order-contiguous bucket column ``__bucket``.

    ``bucket`` is a unit (``'hour'``, ``'day'``, ...), a Column monotone in
    the order, or ``'adaptive:<unit>'``: buckets of that unit, except that a
    HOT bucket of an entity (more than ``target_rows`` rows, e.g. one key
    holding a third of the data) is cut into equal-width time slices sized
    for ``target_rows`` rows. One partial aggregate counts rows per
    (entity, bucket); the hot list has at most rows / ``target_rows`` entries,
    is materialised in the shared folder and broadcast after a bounded count.
    The bucket is then the struct (coarse, slice), still monotone in the order.
    """
    if not (isinstance(bucket, str) and bucket.startswith("adaptive")):
        return df.withColumn(_B, _bucket_expr(df, order_by, bucket))
    from cadence.functions.scalars import epoch_us
    from cadence.plans.sizing import bounded_broadcast
    from cadence.session import cut_lineage

    unit = bucket.split(":", 1)[1] if ":" in bucket else "day"
    width = _UNIT_US[unit]
    parts = list(partition_by or [])
    ts = order_by[0]
    x = df.withColumn("__tus", epoch_us(ts)).withColumn("__cb", F.floor(F.col("__tus") / F.lit(width)))
    hot = x.groupBy(*parts, "__cb").agg(F.count(F.lit(1)).alias("__n")) \
        .filter(F.col("__n") > F.lit(target_rows)) \
        .select(*parts, "__cb", F.greatest(F.floor(F.lit(width) * F.lit(target_rows) / F.col("__n")),
                                           F.lit(1)).cast("bigint").alias("__w"))
    hot = bounded_broadcast(cut_lineage(hot), 5_000_000)
    x = x.join(hot, on=[*parts, "__cb"], how="left")
    sub = F.when(F.col("__w").isNull(), F.lit(0)).otherwise(
        F.floor((F.col("__tus") - F.col("__cb") * F.lit(width)) / F.col("__w")))
    return x.withColumn(_B, F.struct(F.col("__cb").alias("c"), sub.cast("bigint").alias("s"))) \
        .drop("__tus", "__cb", "__w")


def _keyed(df: DataFrame, parts: list[str]) -> DataFrame:
    """Add the (partition, bucket) key as one struct. A struct is never null
    itself and its null fields equal each other, so a plain equi-join on it
    keeps rows with a null partition key or a null time (they stand in buckets
    of their own), and the window's partitioning serves the join as well."""
    p = F.struct(F.lit(0).alias("z"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(parts)])
    return df.withColumn(_PK, F.struct(p.alias("p"), F.col(_B).alias("b")))


def run_ids(df: DataFrame, keys, order_by, partition_by=None, bucket=None,
            run_col: str = "run_id", flags: bool = False) -> DataFrame:
    """Add ``run_col`` (0-based consecutive-run number, per ``partition_by``).

    ``keys`` may be column names or Columns (a user grouping function, N4);
    an empty ``keys`` makes every row its own run (E2), so the run number is
    then the row's 0-based position in the order; a whole table is then
    numbered by range partitions, however its rows lie in time.
    ``order_by`` must be a total order inside a partition (add a unique
    tie-break column). ``flags=True`` also adds ``run_start``/``run_end``
    booleans (first/last row of its run), computed in the same window pass
    plus the neighbouring bucket's merge flag from the summary.
    """
    keys = _cols(keys)
    order = _cols(order_by)
    parts = list(partition_by or [])
    if not keys and not parts and bucket is None and not flags:
        return dense_numbers(df, order, run_col)
    kstruct = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) if keys else None
    x = _keyed(with_bucket(df, order_by, bucket, parts), parts)
    w_local = Window.partitionBy(_PK).orderBy(*order)
    if kstruct is None:
        chg = F.lit(1)
    else:
        x = x.withColumn("__k", kstruct)
        prev = F.lag("__k").over(w_local)
        chg = F.when(F.row_number().over(w_local) == 1, F.lit(1)) \
               .when(prev.eqNullSafe(F.col("__k")), F.lit(0)).otherwise(F.lit(1))
    x = x.withColumn("__chg", chg)
    x = x.withColumn("__local", F.sum("__chg").over(
        w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if flags:
        x = x.withColumn("__bf", F.row_number().over(w_local) == 1) \
             .withColumn("__nchg", F.lead("__chg").over(w_local))

    # one row per (partition, bucket)
    okey = F.struct(*order)
    aggs = [F.max("__local").alias("__n")]
    if kstruct is not None:
        aggs += [F.min_by("__k", okey).alias("__first"), F.max_by("__k", okey).alias("__last")]
    summ = x.groupBy(_PK).agg(*aggs)
    w_b = Window.partitionBy(f"{_PK}.p").orderBy(f"{_PK}.b")
    if kstruct is None:
        merge = F.lit(0)
    else:
        merge = F.when(F.lag("__last").over(w_b).eqNullSafe(F.col("__first")), 1).otherwise(0)
    summ = summ.withColumn("__m", merge)
    summ = summ.withColumn("__off", F.coalesce(F.sum(F.col("__n") - F.col("__m")).over(
        w_b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__m"))
    keep = ["__off"]
    if flags:
        summ = summ.withColumn("__nm", F.lead("__m").over(w_b))
        keep += ["__m", "__nm"]
    summ = summ.select(_PK, *keep)
    # the summary has one row per bucket: AQE broadcasts it from its measured
    # shuffle size (counting it up front would re-run the whole upstream plan)
    out = x.join(summ, on=_PK, how="inner")
    out = out.withColumn(run_col, (F.col("__off") + F.col("__local") - 1).cast("bigint"))
    if flags:
        out = out.withColumn("run_start", (F.col("__chg") == 1) & ~(F.col("__bf") & (F.col("__m") == 1))) \
            .withColumn("run_end", F.when(F.col("__nchg").isNotNull(), F.col("__nchg") == 1)
                        .otherwise(F.coalesce(F.col("__nm") != 1, F.lit(True))))
    return out.drop(_B, _PK, "__k", "__chg", "__local", "__off", "__bf", "__nchg", "__m", "__nm")


def row_positions(df: DataFrame, order_by, partition_by=None, bucket=None,
                  col: str = "pos") -> DataFrame:
    """0-based position of each row in the order, without a global window."""
    return run_ids(df, [], order_by, partition_by, bucket, run_col=col)


def chunk_ids(df: DataFrame, n: int, order_by, partition_by=None, bucket=None,
              col: str = "chunk_id") -> DataFrame:
    """Fixed-size chunks of an ordered table (E8): ``floor(pos / n)``. The whole table
    is numbered by range partitions, parts of it (or given buckets) by windows."""
    if partition_by or bucket is not None:
        x = row_positions(df, order_by, partition_by, bucket, col="__pos")
    else:
        x = dense_numbers(df, _cols(order_by), "__pos")
    return x.withColumn(col, F.floor(F.col("__pos") / F.lit(n)).cast("bigint")).drop("__pos")


def features_by_run(df: DataFrame, specs: list[dict], keys, order_by, ts_col: str,
                    id_col: str, partition_by=None, bucket=None,
                    member_ids: bool = False, run_col: str = "run_id") -> DataFrame:
    """One row per run with its features.

    Output: ``partition_by``, ``run_col``, the run's key values, ``_ts`` (first
    element's timestamp), ``n_elements``, ``first_id``, ``last_id``, then one
    DOUBLE column per feature title. ``member_ids=True`` also adds the sorted
    member-id array ``_did``; off by default because a run's size is
    unbounded (a hot key's run is collected into one row).
    """
    parts = list(partition_by or [])
    if keys and not member_ids:
        found = _features_by_parts(df, specs, keys, order_by, ts_col, id_col, parts, bucket, run_col)
        if found is not None:
            return found
    r = run_ids(df, keys, order_by, parts, bucket, run_col=run_col, flags=True)
    order = F.struct(*_cols(order_by))
    feats = compile_features(specs, df.schema, order=order,
                             edges=(F.col("run_start"), F.col("run_end")))
    # the run's key values are constant inside a run: grouping columns, not
    # aggregates; start/end rows come from the run flags, so every aggregate
    # here has a fixed-width buffer and Spark can hash-aggregate
    key_cols = [k for k in (keys or []) if isinstance(k, str)]
    first = lambda c: F.max(F.when(F.col("run_start"), F.col(c)))
    aggs = [first(ts_col).alias("_ts"),
            F.count(F.lit(1)).alias("n_elements"),
            first(id_col).alias("first_id"),
            F.max(F.when(F.col("run_end"), F.col(id_col))).alias("last_id")]
    if member_ids:
        aggs.append(F.array_sort(F.collect_list(id_col)).alias("_did"))
    out = r.groupBy(*parts, run_col, *key_cols).agg(*aggs, *feats)
    return out.select(*parts, run_col, *key_cols, *[c for c in out.columns
                                                     if c not in set(parts) | {run_col} | set(key_cols)])


def _features_by_parts(df: DataFrame, specs: list[dict], keys, order_by, ts_col: str, id_col: str, parts: list[str], bucket,
                       run_col: str) -> DataFrame | None:
    """``features_by_run`` from one scan and one shuffle of the rows, or None if
    a feature needs all rows of a run at once.

    The rows of a bucket's local runs are aggregated where the window has put
    them; one row for each local run is written. Buckets are stitched by their
    first and last local run, and only runs that reach into another bucket are
    put together from their parts.
    """
    from cadence.session import cut_lineage

    start, end = F.col("__chg") == 1, F.coalesce(F.col("__nchg"), F.lit(1)) == 1
    feats = mergeable_features(specs, df.schema, (start, end))
    if feats is None:
        return None
    kcols = _cols(keys)
    key_cols = [k for k in keys if isinstance(k, str)]
    x = _keyed(with_bucket(df, order_by, bucket, parts), parts)
    x = x.withColumn("__k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(kcols)]))
    w = Window.partitionBy(_PK).orderBy(*_cols(order_by))
    x = x.withColumn("__chg", F.when((F.row_number().over(w) > 1) & F.lag("__k").over(w).eqNullSafe(F.col("__k")), 0).otherwise(1))
    x = x.withColumn("__local", F.sum("__chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))) \
        .withColumn("__nchg", F.lead("__chg").over(w))
    first = lambda c, flag=start: F.max(F.when(flag, F.struct(F.col(c).alias("v"))))
    edge = [Mergeable("_ts", first(ts_col), lambda p, o: F.min_by(p, o), lambda p: p.v),
            Mergeable("n_elements", F.count(F.lit(1)), lambda p, o: F.sum(p), lambda p: p),
            Mergeable("first_id", first(id_col), lambda p, o: F.min_by(p, o), lambda p: p.v),
            Mergeable("last_id", first(id_col, end), lambda p, o: F.max_by(p, o), lambda p: p.v)]
    every = edge + [f._replace(final=lambda p, g=f.final: g(p).cast("double")) for f in feats]
    # grouped within the window's own partitions, so without another shuffle
    seg = cut_lineage(x.groupBy(_PK, "__local", "__k", *parts, *key_cols).agg(*[f.partial.alias(f"__f{i}") for i, f in enumerate(every)]))
    summ = seg.groupBy(_PK).agg(F.max("__local").alias("__n"), F.min_by("__k", "__local").alias("__first"),
                                F.max_by("__k", "__local").alias("__last"))
    wb = Window.partitionBy(f"{_PK}.p").orderBy(f"{_PK}.b")
    summ = summ.withColumn("__m", F.when(F.lag("__last").over(wb).eqNullSafe(F.col("__first")), 1).otherwise(0))
    summ = summ.withColumn("__nm", F.coalesce(F.lead("__m").over(wb), F.lit(0))).withColumn(
        "__off", F.coalesce(F.sum(F.col("__n") - F.col("__m")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__m"))
    j = seg.join(summ.select(_PK, "__n", "__m", "__nm", "__off"), _PK) \
        .withColumn(run_col, (F.col("__off") + F.col("__local") - 1).cast("bigint"))
    crosses = ((F.col("__local") == 1) & (F.col("__m") == 1)) | ((F.col("__local") == F.col("__n")) & (F.col("__nm") == 1))
    group = [*parts, run_col, *key_cols]
    place = F.struct(F.col(f"{_PK}.b"), F.col("__local"))
    whole = j.filter(~crosses).select(*group, *[F.col(f"__f{i}") for i in range(len(every))]).unionByName(
        j.filter(crosses).groupBy(*group).agg(*[f.merge(F.col(f"__f{i}"), place).alias(f"__f{i}") for i, f in enumerate(every)]))
    return whole.select(*group, *[f.final(F.col(f"__f{i}")).alias(f.title) for i, f in enumerate(every)])


def features_global(df: DataFrame, specs: list[dict], order_by=None) -> DataFrame:
    """The whole input as one group (E7): one row of features."""
    order = F.struct(*_cols(order_by)) if order_by else None
    return df.agg(*compile_features(specs, df.schema, order=order))


def features_by_key(df: DataFrame, specs: list[dict], keys, order_by=None) -> DataFrame:
    """Features over plain (non-consecutive) groups, e.g. per user."""
    order = F.struct(*_cols(order_by)) if order_by else None
    return df.groupBy(*keys).agg(*compile_features(specs, df.schema, order=order))


def custom_run_features(df: DataFrame, fn, schema: str, keys, order_by,
                        partition_by=None, bucket=None, run_col: str = "run_id",
                        runs_per_group: int = 64, arrays: bool = False) -> DataFrame:
    """User feature function over each run's elements.

    ``fn(pandas.DataFrame) -> pandas.DataFrame`` receives one run's rows in
    order, and may as well return a dict, which is one row. Building a frame for every run costs
    more than most functions do: with ``arrays=True``, ``fn`` receives a dict
    of one numpy array for each column instead, its values as in the frame.

    Up to ``runs_per_group`` consecutive runs of an entity go to the same task, which
    reads its runs one after the other in Arrow batches (``mapInPandas``): it
    holds a batch and the run that goes on in the next one. A single run is
    inherently held whole because the function needs all of
    its elements. The output schema must include the columns ``fn`` returns.
    """
    from cadence.session import ship_package

    parts = list(partition_by or [])
    r = run_ids(df, keys, order_by, parts, bucket, run_col=run_col)
    order_names = [c for c in order_by if isinstance(c, str)]
    # the number of shuffle partitions is given, as AQE would coalesce a small
    # shuffle into a few serial Python tasks
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartition(n, *[F.col(p) for p in parts], F.floor(F.col(run_col) / F.lit(runs_per_group))) \
        .sortWithinPartitions(*parts, run_col, *[F.col(c).asc_nulls_last() for c in order_names])
    # a null would turn a whole batch's integers into floats: its place goes beside them
    whole = [f.name for f in r.schema.fields if isinstance(f.dataType, T.IntegralType)]
    plain = r.columns
    gaps = {c: f"__null_{i}" for i, c in enumerate(whole)}
    r = r.withColumns({g: F.col(c).isNull() for c, g in gaps.items()}).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in whole})
    made = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    ship_package(df.sparkSession)
    calls = _run_calls(fn, plain, gaps, [*parts, run_col], {f.name: isinstance(f.dataType, T.IntegralType) for f in made.fields}, arrays)
    return r.mapInPandas(calls, schema=made)


def _run_calls(fn, plain: list[str], gaps: dict[str, str], ident: list[str], fields: dict[str, bool], arrays: bool):
    """Task side of ``custom_run_features``: batches of sorted rows to ``fn``'s rows."""

    def call(batches):
        import numpy as np
        import pandas as pd

        def borders(b):
            """Places in the batch at which another run begins."""
            new = np.zeros(max(len(b) - 1, 0), dtype=bool)
            for c in ident:
                v = b[c].to_numpy()
                same = v[1:] == v[:-1]
                if c in gaps:
                    g = b[gaps[c]].to_numpy()
                    same &= g[1:] == g[:-1]
                else:
                    null = pd.isna(v)
                    same = same.astype(bool) | (null[1:] & null[:-1])
                new |= ~same.astype(bool)
            return (np.flatnonzero(new) + 1).tolist()

        def results(b):
            """``fn``'s result for each run of a batch of whole runs."""
            cuts = [0, *borders(b), len(b)]
            null = {c: b[g].to_numpy(dtype=bool) for c, g in gaps.items()}
            null = {c: m for c, m in null.items() if m.any()}
            # a column of numbers once more with its nulls, for the runs that have one
            holed = {c: np.where(m, np.nan, b[c].to_numpy().astype("float64")) for c, m in null.items()}
            b = b[plain]
            values = {c: b[c].to_numpy() for c in plain} if arrays else {}
            for i, j in zip(cuts, cuts[1:]):
                gone = [c for c, m in null.items() if m[i:j].any()]
                if arrays:
                    run = {c: v[i:j] for c, v in values.items()}
                    for c in gone:
                        run[c] = holed[c][i:j]
                else:
                    run = b.iloc[i:j].copy()
                    run.index = pd.RangeIndex(j - i)
                    for c in gone:
                        run[c] = holed[c][i:j]
                yield fn(run)

        def integers(v):
            """Whole numbers and nulls, without the way over floats."""
            return pd.Series([None if x is None or x is pd.NA or x != x else int(x) for x in v], dtype=object)

        def frame(found):
            rows = [x for x in found if isinstance(x, dict)]
            made = [x for x in found if not isinstance(x, dict) and len(x)]
            for c in (c for c, number in fields.items() if number):
                if len({m[c].dtype for m in made if c in m}) > 1:
                    made = [m.assign(**{c: integers(m[c]).to_numpy()}) for m in made]
            if rows:
                made.append(pd.DataFrame({c: integers([x[c] for x in rows]) if number else [x[c] for x in rows]
                                          for c, number in fields.items()}))
            return pd.concat(made, ignore_index=True) if made else None

        def answer(b):
            out = frame(list(results(b)))
            return [] if out is None else [out]

        held = []       # the last run so far, in pieces
        for b in batches:
            if not len(b):
                continue
            if held:
                first = pd.concat([held[-1].iloc[-1:], b.iloc[:1]], ignore_index=True)
                cuts = borders(b)
                if borders(first):                      # the batch begins with another run
                    yield from answer(pd.concat(held, ignore_index=True))
                    held = []
                elif cuts:
                    yield from answer(pd.concat([*held, b.iloc[:cuts[0]]], ignore_index=True))
                    b, held = b.iloc[cuts[0]:].reset_index(drop=True), []
                else:
                    held.append(b)
                    continue
            last = (borders(b) or [0])[-1]
            if last:
                yield from answer(b.iloc[:last].reset_index(drop=True))
            held = [b.iloc[last:].reset_index(drop=True)]
        if held:
            yield from answer(pd.concat(held, ignore_index=True))

    return call


def avg_features(df: DataFrame, names: list[str]) -> DataFrame:
    """Average of each feature column over the table."""
    return df.agg(*[F.avg(F.col(n)).alias(n) for n in names])


def proportion(col: Column | str, item) -> Column:
    """Share of rows equal to ``item`` (D27), an aggregate Column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.avg(F.when(c == F.lit(item), 1.0).otherwise(0.0))


def fold_mean(df: DataFrame, vec: str, d: int, id_col: str | None = None) -> DataFrame:
    """NaN-ignoring mean by position modulo ``d``.

    The vector is exploded to (position, value); the aggregate is keyed by
    ``pos % d`` only, so partial aggregation collapses it map-side.
    """
    x = df.select(F.posexplode(vec).alias("pos", "v"))
    x = x.withColumn("v", F.col("v").cast("double"))
    x = x.filter(~F.isnan("v") & F.col("v").isNotNull())
    return x.groupBy((F.col("pos") % d).alias("dim")).agg(F.avg("v").alias("mean"))


def group_collect(df: DataFrame, key: str, item: str) -> DataFrame:
    """Count and list of items per key (D29, ``$group/$sum/$push``).

    The item list is a per-key array, so only use it on pre-aggregated items
    (e.g. one entry per user-day), never on raw rows of a hot key.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"),
                               F.collect_list(item).alias("items"))


def shifted(df: DataFrame, value: str | Column, order_by, partition_by=None, bucket=None,
            direction: str = "lag", out: str = "prev") -> DataFrame:
    """Previous (``lag``) or next (``lead``) value in the order, per partition,
    without a window over a whole partition: local lag/lead inside
    ``(partition_by, bucket)``; the bucket's first (last) row takes the
    neighbouring non-empty bucket's last (first) value from a per-bucket
    summary. Null when there is no neighbour.
    """
    parts = list(partition_by or [])
    order = _cols(order_by)
    v = F.col(value) if isinstance(value, str) else value
    x = _keyed(with_bucket(df, order_by, bucket, parts), parts).withColumn("__v", F.struct(v.alias("v")))
    w = Window.partitionBy(_PK).orderBy(*order)
    fn = F.lag if direction == "lag" else F.lead
    x = x.withColumn("__loc", fn("__v").over(w))
    okey = F.struct(*order)
    summ = x.groupBy(_PK).agg(F.max_by("__v", okey).alias("__last"), F.min_by("__v", okey).alias("__first"))
    wb = Window.partitionBy(f"{_PK}.p").orderBy(f"{_PK}.b")
    nb = F.lag("__last").over(wb) if direction == "lag" else F.lead("__first").over(wb)
    summ = summ.select(_PK, nb.alias("__nb"))
    j = x.join(summ, on=_PK, how="inner")
    j = j.withColumn(out, F.coalesce(F.col("__loc"), F.col("__nb")).getField("v"))
    return j.drop(_B, _PK, "__v", "__loc", "__nb")


def preceding(df: DataFrame, value: str | Column, n: int, order_by, partition_by=None, bucket=None,
              out: str = "prev") -> DataFrame:
    """The up to ``n`` values before each row in the order, oldest first, as an array
    of structs ``v`` (so that a null value differs from no row), per partition.

    One window pass for all of them: a bucket takes the last ``n`` rows of the
    buckets before it from a summary with one row per bucket.
    """
    parts = list(partition_by or [])
    order = _cols(order_by)
    v = F.col(value) if isinstance(value, str) else value
    newest = lambda a: F.slice(a, F.greatest(F.size(a) - F.lit(n - 1), F.lit(1)), F.lit(n))
    x = _keyed(with_bucket(df, order_by, bucket, parts), parts).withColumn("__v", F.struct(v.alias("v")))
    x = x.withColumn("__loc", F.collect_list("__v").over(Window.partitionBy(_PK).orderBy(*order).rowsBetween(-n, -1)))
    ends = x.groupBy(_PK).agg(F.max_by(F.concat("__loc", F.array("__v")), F.struct(*order)).alias("__end"))
    # each bucket has at least one row, so n buckets hold the n rows before
    before = Window.partitionBy(f"{_PK}.p").orderBy(f"{_PK}.b").rowsBetween(-n, -1)
    ends = ends.select(_PK, newest(F.flatten(F.collect_list(newest(F.col("__end"))).over(before))).alias("__before"))
    j = x.join(ends, on=_PK, how="inner").withColumn(out, newest(F.concat("__before", "__loc")))
    return j.drop(_B, _PK, "__v", "__loc", "__before")


def suffix_any(df: DataFrame, cond: Column, order_by, partition_by=None, bucket=None,
               out: str = "later") -> DataFrame:
    """Whether ``cond`` holds on any STRICTLY later row of the partition.

    Local suffix inside ``(partition_by, bucket)`` (reverse running max), plus
    "any later bucket" from a per-bucket summary.
    """
    parts = list(partition_by or [])
    order = _cols(order_by)
    x = _keyed(with_bucket(df, order_by, bucket, parts), parts).withColumn("__c", F.coalesce(cond, F.lit(False)).cast("int"))
    rev = [c.desc() for c in order]
    w = Window.partitionBy(_PK).orderBy(*rev) \
        .rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__loc", F.coalesce(F.max("__c").over(w), F.lit(0)))
    summ = x.groupBy(_PK).agg(F.max("__c").alias("__bc"))
    wb = Window.partitionBy(f"{_PK}.p").orderBy(F.col(f"{_PK}.b").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(_PK, F.coalesce(F.max("__bc").over(wb), F.lit(0)).alias("__nb"))
    j = x.join(summ, on=_PK, how="inner")
    j = j.withColumn(out, (F.greatest("__loc", "__nb") == 1))
    return j.drop(_B, _PK, "__c", "__loc", "__nb")
