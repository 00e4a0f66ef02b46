"""Consecutive-run features over a stream (M1, M2, M3).

Rows come in any order within the watermark's delay. Per entity, the state
(``transformWithState``, RocksDB) holds the rows that the watermark has not
passed yet, which a late row may still split or merge, and the rows of the
open run. Rows that the watermark has passed are final: they go on with the
open run or close it. An event-time timer takes up rows that become final
without new ones, and closes an entity's last run when the watermark is
``idle`` past it (M2); without ``idle`` only a completion row does
(``complete``), so that the result is the batch one. With ``idle`` a gap that
is longer ends a run, whenever its rows come.

A closed run leaves with all of its rows at once. Its features are compiled
from any feature definitions by the compiler that the batch operator uses,
inside ``foreachBatch``, and written under the number of the micro-batch: a
batch that is replayed replaces itself (M3).

Rows behind the watermark are dropped by Spark. Entities of which a row is
missing are computed again from their raw rows (``with_late_rows``; the source
folder, or the sink to which they are appended next to the features), so that
none leaves the result.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from bisect import bisect_left
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from cadence.functions.features import compile_features, spec
from cadence.operators.runs import features_by_run
from cadence.session import scratch_path, ship_package

#: Event time of completion rows (pandas ends in 2262), and the time at which a watermark means completion (microseconds).
COMPLETE_AT = "2261-01-01 00:00:00"
_COMPLETED_US = 9151488000_000_000
_ROW = "ts_us bigint, id string, run_key string, payload string"
_RUN = "run_id bigint, run_key string, last_us bigint, stored boolean, waiting string, fresh string"
#: Rows of an open run that stay beside its number; more of them go to a list.
_BESIDE = 500
_OUT = "entity string, run_id bigint, run_start boolean, run_end boolean, payload string"
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

FLAGSHIP = [spec("direct", "sum", "value", title="total_value"), spec("direct", "mean", "value", title="mean_value"),
            spec("direct", "count", "value", title="n_values"), spec("direct", "hour", "ts", title="avg_hour"),
            spec("direct", "std", "value", title="std_value"), spec("direct", "max", "value", title="max_value")]

# the driver's own state worker does not see files that executors get, so the processor travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ClosedRuns(StatefulProcessor):
    """Emits the rows of each run of an entity when the run is closed."""

    def __init__(self, idle_us: int | None):
        self.idle_us = idle_us

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("open_rows", _ROW)
        self.run = handle.getValueState("open_run", _RUN)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.ts_us, r.id, r.run_key, r.payload) for r in rows]
        # a completion row only moves the watermark
        yield from self._advance(key, [r for r in new if r[0] < _COMPLETED_US], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, new: list[tuple], timers) -> Iterator[Row]:
        passed, idle = timers.getCurrentWatermarkInMs() * 1000, self.idle_us
        # few calls for each entity: every one goes to the state server and back, so one value holds all but long open runs
        state = self.run.get()
        *run, stored, waiting, fresh = (-1, None, None, False, "[]", "[]") if state is None else tuple(state)
        run = tuple(run)
        waiting, fresh = ([tuple(r) for r in json.loads(x)] for x in (waiting, fresh))  # fresh: of the open run, behind those in the list
        rows = sorted(waiting + new, key=lambda r: (r[0], int(r[1]) if r[1].lstrip("-").isdigit() else 0, r[1]))
        final = bisect_left([r[0] for r in rows], passed)
        rows, rest = rows[:final], rows[final:]
        out: list[tuple] = []
        known = run[0] >= 0 or bool(waiting)
        if rows:
            most = _COMPLETED_US if idle is None else idle
            borders = [0, *(i for i in range(1, len(rows)) if rows[i][2] != rows[i - 1][2] or rows[i][0] - rows[i - 1][0] > most), len(rows)]
            for i, j in zip(borders, borders[1:]):
                if run[1] is None or run[1] != rows[i][2] or i or (idle is not None and rows[i][0] - run[2] > idle):
                    self._emit(run, stored, fresh, out)
                    run, stored, fresh = (run[0] + 1, rows[i][2], None), False, []
                fresh = fresh + rows[i:j]
                run = (run[0], run[1], rows[j - 1][0])
        if run[1] is not None and not rest and passed > (_COMPLETED_US if idle is None else run[2] + idle):
            self._emit(run, stored, fresh, out)
            run, stored, fresh = (run[0], None, None), False, []
        if len(fresh) > _BESIDE:
            (self.rows.appendList if stored else self.rows.put)(fresh)
            stored, fresh = True, []
        if idle is not None and (rest or run[1] is not None):
            self.handle.registerTimer((rest[-1][0] if rest else run[2] + idle) // 1000 + 1)
        elif not known:  # what is final by then leaves with the entity's next rows, the rest at completion
            self.handle.registerTimer(_COMPLETED_US // 1000 + 1)
        self.run.update((*run, stored, json.dumps(rest), json.dumps(fresh)))
        for number, payload in out:
            n = len(payload) - 1
            yield from (Row(entity=key[0], run_id=number, run_start=i == 0, run_end=i == n, payload=p) for i, p in enumerate(payload))

    def _emit(self, run: tuple, stored: bool, fresh: list[tuple], out: list) -> None:
        """The rows of the open run go out, and the state forgets them."""
        if run[1] is None:
            return
        payload = [r[3] for r in self.rows.get()] if stored else []
        if stored:
            self.rows.clear()
        payload += [r[3] for r in fresh]
        out.append((run[0], payload))


def closed_runs(sdf: DataFrame, entity: str, keys: list[str], ts: str, id_col: str, delay: str = "2 hours",
                idle_seconds: float | None = None) -> DataFrame:
    """The rows of ``sdf`` with ``run_id, run_start, run_end``, each run when it
    is closed. The query must run with ``state_store(spark)`` in force."""
    spark = sdf.sparkSession
    ship_package(spark)
    when = F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_micros(F.lit(0)))
    x = sdf.select(F.col(entity).cast("string").alias("entity"), when.alias("event_time"), F.unix_micros(when).alias("ts_us"),
                   F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                   F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("run_key"),
                   F.to_json(F.struct(*[F.col(c) for c in sdf.columns]), _JSON).alias("payload"))
    out = x.withWatermark("event_time", delay).groupBy("entity").transformWithState(
        ClosedRuns(None if idle_seconds is None else int(idle_seconds * 1e6)), _OUT, "append", "EventTime")
    row = F.from_json("payload", sdf.schema, {**_JSON, "allowNonNumericNumbers": "true"})
    return out.select("run_id", "run_start", "run_end", row.alias("r")).select("run_id", "run_start", "run_end", "r.*")


def run_features(rows: DataFrame, specs: list[dict], entity: str, keys: list[str], ts: str, id_col: str) -> DataFrame:
    """Features of closed runs, as ``features_by_run`` gives them."""
    flags = F.col("run_start"), F.col("run_end")
    at = lambda flag, c: F.max(F.when(flag, F.col(c)))
    feats = compile_features(specs, rows.schema, order=F.struct(ts, id_col), edges=flags)
    return rows.groupBy(entity, "run_id", *keys).agg(
        at(flags[0], ts).alias("_ts"), F.count(F.lit(1)).alias("n_elements"), at(flags[0], id_col).alias("first_id"),
        at(flags[1], id_col).alias("last_id"), *feats)


class state_store:
    """Within it, stateful queries start with the RocksDB store that timers and
    list state need; the session's own setting returns afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.old = self.spark.conf.get(_PROVIDER, None)
        self.spark.conf.set(_PROVIDER, _ROCKS)

    def __exit__(self, *exc) -> None:
        if self.old is None:
            self.spark.conf.unset(_PROVIDER)
        else:
            self.spark.conf.set(_PROVIDER, self.old)


def write_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Write a micro-batch under its number, so that a replay replaces itself (M3)."""
    batch.write.mode("overwrite").parquet(os.path.join(path, f"batch={epoch}"))


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All micro-batches that ``write_batch`` has written."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def complete(spark: SparkSession, folder: str, schema: T.StructType, ts: str, rows: list[dict] | None = None) -> None:
    """Add the completion row (or ``rows``) to a stream's folder: its event time
    lies behind all others, so the watermark passes everything that came."""
    values = [[r.get(f.name) for f in schema.fields] for r in rows or [{}]]
    strings = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    x = spark.createDataFrame(values, strings).withColumn(ts, F.lit(COMPLETE_AT).cast(schema[ts].dataType))
    x.coalesce(1).write.parquet(os.path.join(folder, "zz-complete"))


def stage_files(df: DataFrame, part: Column, n: int, files: int = 1) -> str:
    """``df`` as ``n`` folders of ``files`` files (fewer, if rows are few), written one after the other by the
    number ``part`` gives, for a file stream to take in that order."""
    folder = scratch_path(df.sparkSession, f"stream-in-{uuid.uuid4().hex[:12]}")
    for i in range(n):
        rows = df.filter(part == i)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(os.path.join(folder, f"part-{i:03d}"))
    return folder


def with_late_rows(features: DataFrame, raw: DataFrame, specs: list[dict], entity: str, keys: list[str], ts: str,
                   id_col: str) -> DataFrame:
    """``features`` with those entities computed again that miss raw rows: rows
    behind the watermark, which the stream has dropped."""
    got = features.groupBy(F.col(entity).alias("e")).agg(F.sum("n_elements").alias("got"))
    came = raw.groupBy(F.col(entity).alias("e")).agg(F.count(F.lit(1)).alias("came"))
    same = F.col("l.e").eqNullSafe(F.col("r.e"))
    late = came.alias("l").join(got.alias("r"), same & (F.col("came") == F.col("got")), "left_anti").select("e")
    again = raw.join(late, F.col(entity).eqNullSafe(F.col("e")), "left_semi")
    fresh = features_by_run(again, specs, keys, [ts, id_col], ts, id_col, partition_by=[entity], bucket="adaptive:day")
    return features.join(late, F.col(entity).eqNullSafe(F.col("e")), "left_anti").unionByName(fresh.select(*features.columns))


def stream_features_to_table(spark: SparkSession, source: str, schema: T.StructType, specs: list[dict], entity: str,
                             keys: list[str], ts: str, id_col: str, delay: str = "2 hours", idle_seconds: float | None = None,
                             max_files_per_trigger: int = 1, raw_sink: str | None = None, late: bool = True) -> DataFrame:
    """M1-M3 over a folder of files (``availableNow``): closed runs' features of
    any ``specs``, raw rows beside them in ``raw_sink``, late rows worked in. Checkpoints and
    tables live in the shared checkpoint folder."""
    sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).option(
        "recursiveFileLookup", "true").parquet(source)
    name = uuid.uuid4().hex[:12]
    out, ck = scratch_path(spark, f"stream-runs-{name}"), scratch_path(spark, f"stream-ckpt-{name}")
    rows = closed_runs(sdf, entity, keys, ts, id_col, delay, idle_seconds)
    shape = run_features(spark.createDataFrame([], rows.schema), specs, entity, keys, ts, id_col).schema
    with state_store(spark):
        feats = rows.writeStream.outputMode("append").foreachBatch(
            lambda b, epoch: write_batch(run_features(b, specs, entity, keys, ts, id_col), epoch, out)
        ).option("checkpointLocation", ck).trigger(availableNow=True).start()
    raw = append_raw_stream(sdf, raw_sink, ck + "-raw") if raw_sink else None
    feats.awaitTermination()
    if raw:
        raw.awaitTermination()
    found = read_batches(spark, out, shape)
    if not late:
        return found
    came = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(raw_sink or source)
    came = came.filter(F.col(ts).isNull() | (F.unix_micros(F.col(ts).cast("timestamp")) < _COMPLETED_US))
    return with_late_rows(found, came, specs, entity, keys, ts, id_col)


def _both(spark: SparkSession, a: str, b: str) -> str:
    """One pattern for two folders of a file system."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    uris = []
    for p in (a, b):
        path = jvm.Path(p)
        uris.append(path.getFileSystem(conf).makeQualified(path).toUri())
    roots = {(u.getScheme(), u.getAuthority()) for u in uris}
    if len(roots) > 1:
        raise ValueError("the source must lie in the checkpoint folder's file system")
    (scheme, host), = roots
    return f"{scheme}://{host or ''}/{{{','.join(u.getPath().lstrip('/') for u in uris)}}}"


def run_stream_to_table(spark: SparkSession, source_dir: str, schema, entity: str, key: str, ts: str,
                        id_col: str, value: str, raw_sink: str | None = None,
                        max_files_per_trigger: int = 1) -> DataFrame:
    """The flagship features of ``value`` by runs of ``key`` over all files of a
    folder; the last run of each entity is closed by a completion row."""
    specs = [dict(s, key=value if s["key"] == "value" else ts) for s in FLAGSHIP]
    name = uuid.uuid4().hex[:12]
    done = scratch_path(spark, f"stream-done-{name}")
    complete(spark, done, schema, ts)
    rows = stream_features_to_table(spark, _both(spark, source_dir, done), schema, specs, entity, [key], ts, id_col,
                                    max_files_per_trigger=max_files_per_trigger, raw_sink=raw_sink)
    return rows.withColumnRenamed(entity, "entity")


def append_raw_stream(sdf: DataFrame, path: str, checkpoint: str):
    """M3: continuous raw append next to the features (parquet file sink,
    exactly-once through the sink's own commit log)."""
    return sdf.writeStream.format("parquet").option("path", path) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def materialize_stream(sdf: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming DataFrame over the available input (``availableNow``)
    into a parquet table in the shared checkpoint folder and return it as a
    batch DataFrame (``complete`` mode overwrites each micro-batch)."""
    spark = sdf.sparkSession
    run = uuid.uuid4().hex[:12]
    out = scratch_path(spark, f"stream-out-{run}")

    def write(batch: DataFrame, epoch: int):
        write_batch(batch, 0 if mode == "complete" else epoch, out)

    q = sdf.writeStream.outputMode(mode).foreachBatch(write) \
        .option("checkpointLocation", scratch_path(spark, f"stream-ckpt-{run}")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return read_batches(spark, out, sdf.schema)
