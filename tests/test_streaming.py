"""Streaming = batch: three files of ordered events through the stateful
run operator give the same per-user run features as the batch operator."""

import os
import tempfile

from pyspark.sql import functions as F

from cadence.functions.features import spec
from cadence.operators.runs import features_by_run
from cadence.streaming import runs as SR

SPECS = [spec("direct", "sum", "value", title="total_value"), spec("direct", "count", "value", title="n_values"),
         spec("direct", "max", "value", title="max_value")]


def test_stream_runs_equal_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = tempfile.mkdtemp(prefix="cadence-stream-src-")
    bounds = ev.select(F.percentile_approx("event_id", [0.33, 0.66]).alias("b")).first()["b"]
    parts = [ev.filter(F.col("event_id") < bounds[0]),
             ev.filter((F.col("event_id") >= bounds[0]) & (F.col("event_id") < bounds[1])),
             ev.filter(F.col("event_id") >= bounds[1])]
    for i, p in enumerate(parts):        # three files, in time order (event ids grow with time)
        p.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
    files = [os.path.join(src, f"part{i}", f) for i in range(3)
             for f in os.listdir(os.path.join(src, f"part{i}")) if f.endswith(".parquet")]
    flat = tempfile.mkdtemp(prefix="cadence-stream-flat-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"{i:03d}.parquet"))
    got = SR.run_stream_to_table(spark, flat, ev.schema, "user_id", "event_type", "ts", "event_id", "value")
    batch = features_by_run(ev, SPECS, ["event_type"], ["ts", "event_id"], "ts", "event_id",
                            partition_by=["user_id"], bucket="day")
    a = {(r["entity"], r["run_id"]): (r["n_elements"], round(r["total_value"], 6), round(r["max_value"], 6))
         for r in got.collect()}
    b = {(r["user_id"], r["run_id"]): (r["n_elements"], round(r["total_value"], 6), round(r["max_value"], 6))
         for r in batch.collect()}
    assert a == b and len(a) > 100


def _staged(spark, rows, schema, n, part):
    df = spark.createDataFrame(rows, schema)
    folder = SR.stage_files(df, part, n)
    SR.complete(spark, folder, df.schema, "ts")
    return df, folder


def test_rows_out_of_order_over_files_equal_batch(spark):
    """Rows up to two hours out of order split and merge runs; any features; std near 1e9."""
    import random
    from datetime import datetime, timedelta
    rng = random.Random(7)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=i * 90, microseconds=i), rng.randrange(4), rng.choice("aab") if i % 9 else None,
             1e9 + rng.random() if i % 11 else None) for i in range(900)]
    place = {i: min(2, max(0, int((i * 90 + rng.randrange(-3000, 3000)) // 27000))) for i in range(900)}
    schema = "id bigint, ts timestamp, user bigint, kind string, value double"
    part = F.element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col("id"))
    df, folder = _staged(spark, rows, schema, 3, part)
    specs = SPECS + [spec("direct", "std", "value", title="s"), spec("direct", "mode", "value", title="m"),
                     spec("direct", "hour", "ts", index="first", title="h"), spec("direct", "sum", "value", index="last", title="l")]
    got = SR.stream_features_to_table(spark, folder, df.schema, specs, "user", ["kind"], "ts", "id", delay="2 hours", late=False)
    want = features_by_run(df, specs, ["kind"], ["ts", "id"], "ts", "id", partition_by=["user"], bucket="day")
    # sums of doubles depend on the order of their rows
    plain = lambda rows: sorted(repr([f"{v:.{5 if c == 's' else 10}g}" if isinstance(v, float) else v for c, v in r.asDict().items()])
                                for r in rows)
    assert plain(got.select(*want.columns).collect()) == plain(want.collect())


def test_idle_runs_close_and_late_rows_are_worked_in(spark):
    from datetime import datetime, timedelta
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(hours=i), i % 2, "a", float(i)) for i in range(40)] + [(100, t0 + timedelta(minutes=90), 0, "b", 5.0)]
    part = F.when(F.col("id") < 20, 0).when(F.col("id") < 40, 1).otherwise(2)  # row 100 comes days late
    df, folder = _staged(spark, rows, "id bigint, ts timestamp, user bigint, kind string, value double", 3, part)
    want = features_by_run(df, SPECS, ["kind"], ["ts", "id"], "ts", "id", partition_by=["user"], bucket="day")
    got = SR.stream_features_to_table(spark, folder, df.schema, SPECS, "user", ["kind"], "ts", "id", delay="1 hour")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    # a run ends where its entity is silent for 90 minutes: each row of two hours is its own
    idle = SR.stream_features_to_table(spark, folder, df.schema, SPECS, "user", ["kind"], "ts", "id", delay="0 seconds",
                                       idle_seconds=5400, late=False)
    assert idle.count() == 40


def test_a_batch_written_twice_stays_once(spark):
    from cadence.session import scratch_path
    path = scratch_path(spark, "twice")
    for epoch in (0, 1, 1, 0):
        SR.write_batch(spark.range(5).withColumn("epoch", F.lit(epoch)), epoch, path)
    assert SR.read_batches(spark, path, spark.range(1).withColumn("epoch", F.lit(1)).schema).count() == 10


def test_long_open_runs_go_to_the_list_and_leave_whole(spark, monkeypatch):
    """Rows of an open run lie beside its number or in the list; parts of several files are one batch."""
    from datetime import datetime, timedelta
    monkeypatch.setattr(SR, "_BESIDE", 7)
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i // 2), i % 2, "a" if i < 90 or i > 110 else "b", float(i)) for i in range(160)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, user bigint, kind string, value double")
    folder = SR.stage_files(df, F.floor(F.col("id") / 40), 4, files=3)
    assert [sum(f.endswith(".parquet") for f in os.listdir(os.path.join(folder, d))) for d in sorted(os.listdir(folder))] == [3] * 4
    SR.complete(spark, folder, df.schema, "ts")
    got = SR.stream_features_to_table(spark, folder, df.schema, SPECS, "user", ["kind"], "ts", "id", max_files_per_trigger=3, late=False)
    want = features_by_run(df, SPECS, ["kind"], ["ts", "id"], "ts", "id", partition_by=["user"], bucket="day")
    key = lambda x: sorted(tuple(r) for r in x.select("user", "run_id", "kind", "n_elements", "first_id", "last_id", "total_value").collect())
    assert key(got) == key(want) and len(key(got)) == 6
