"""Consecutive runs: key changes, empty keys, bucket stitching, partitions."""

from datetime import datetime, timedelta

from cadence.functions.features import spec
from cadence.operators.runs import chunk_ids, features_by_run, run_ids, shifted, suffix_any


def _ids(df, col="run_id"):
    return [r[col] for r in df.orderBy("id").collect()]


def test_runs_key_change(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i), k)
                                for i, k in enumerate("aaba")], "id long, ts timestamp, k string")
    assert _ids(run_ids(df, ["k"], ["ts", "id"])) == [0, 0, 1, 2]


def test_empty_key_one_run_per_row(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=i), "a") for i in range(5)],
                               "id long, ts timestamp, k string")
    assert _ids(run_ids(df, [], ["ts", "id"])) == [0, 1, 2, 3, 4]


def test_runs_stitch_across_buckets_and_nulls(spark):
    keys = ["a", "a", None, None, "b", "b", "a"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string")
    # hour buckets: every row in its own bucket; runs continue across buckets
    assert _ids(run_ids(df, ["k"], ["ts", "id"], bucket="hour")) == [0, 0, 1, 1, 2, 2, 3]
    assert _ids(run_ids(df, ["k"], ["ts", "id"], bucket="month")) == [0, 0, 1, 1, 2, 2, 3]


def test_runs_per_partition(spark):
    rows = [(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 1, "b"), (5, 2, "a"), (6, 1, "a")]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(days=i), u, k) for i, u, k in rows],
                               "id long, ts timestamp, u long, k string")
    assert _ids(run_ids(df, ["k"], ["ts", "id"], partition_by=["u"], bucket="day")) == [0, 1, 0, 1, 0, 2]


def test_chunks_lag_lead_suffix(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(hours=5 * i), "xyzxy"[i]) for i in range(5)],
                               "id long, ts timestamp, k string")
    assert _ids(chunk_ids(df, 2, ["ts", "id"]), "chunk_id") == [0, 0, 1, 1, 2]
    assert _ids(shifted(df, "k", ["ts", "id"], bucket="day"), "prev") == [None, "x", "y", "z", "x"]
    assert _ids(shifted(df, "k", ["ts", "id"], bucket="day", direction="lead"), "prev") == ["y", "z", "x", "y", None]
    from pyspark.sql import functions as F
    got = _ids(suffix_any(df, F.col("k") == "z", ["ts", "id"], bucket="hour"), "later")
    assert got == [True, True, False, False, False]


def test_run_flags_across_buckets(spark):
    keys = ["a", "a", "a", "b", "b", "a"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=5 * i), k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string")
    r = run_ids(df, ["k"], ["ts", "id"], bucket="day", flags=True).orderBy("id").collect()
    assert [x["run_start"] for x in r] == [True, False, False, True, False, True]
    assert [x["run_end"] for x in r] == [False, False, True, False, True, True]
    r2 = run_ids(df, [], ["ts", "id"], bucket="day", flags=True).collect()
    assert all(x["run_start"] and x["run_end"] for x in r2)


def test_adaptive_buckets_split_hot_entity(spark):
    """One entity holds most rows: adaptive buckets cut its hot day into time
    slices; run numbers, lags and 'later' flags equal the plain bucketing."""
    import random

    from pyspark.sql import functions as F

    from cadence.operators.runs import with_bucket
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        u = 1 if i % 10 else 2 + i % 3                   # user 1 is hot
        rows.append((i, datetime(2024, 1, 1) + timedelta(seconds=20 * i), u, rnd.choice("ab")))
    df = spark.createDataFrame(rows, "id long, ts timestamp, u long, k string")
    plain = run_ids(df, ["k"], ["ts", "id"], partition_by=["u"], bucket="day")
    adapt = run_ids(df, ["k"], ["ts", "id"], partition_by=["u"], bucket="adaptive:day")
    a = {r["id"]: r["run_id"] for r in plain.collect()}
    b = {r["id"]: r["run_id"] for r in adapt.collect()}
    assert a == b
    nb = with_bucket(df, ["ts", "id"], "adaptive:day", ["u"], target_rows=100) \
        .filter(F.col("u") == 1).select("__bucket").distinct().count()
    assert nb > 10                                       # the hot user-day was cut
    lag_a = {r["id"]: r["prev"] for r in shifted(df, "k", ["ts", "id"], ["u"], "day").collect()}
    lag_b = {r["id"]: r["prev"] for r in shifted(df, "k", ["ts", "id"], ["u"], "adaptive:hour").collect()}
    assert lag_a == lag_b
    s_a = {r["id"]: r["later"] for r in suffix_any(df, F.col("k") == "a", ["ts", "id"], ["u"], "day").collect()}
    s_b = {r["id"]: r["later"] for r in suffix_any(df, F.col("k") == "a", ["ts", "id"], ["u"],
                                                   "adaptive:hour").collect()}
    assert s_a == s_b


def test_run_first_last_from_flags_equal_order_pick(spark):
    """index first/last inside runs (picked with the run start/end flags)
    equal ``min_by``/``max_by`` over the order, including null edge values."""
    import random

    from pyspark.sql import functions as F

    from cadence.functions.features import compile_features
    rnd = random.Random(11)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(0, 50_000)), 1 + i % 4,
             rnd.choice("ab"), None if rnd.random() < 0.3 else float(rnd.randrange(100)), rnd.choice(["x", None]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, u long, k string, v double, s string")
    specs = [spec("direct", "field", "v", index="first", title="fv"),
             spec("direct", "field", "v", index="last", title="lv"),
             spec("direct", "hour", "ts", index="last", title="lh"),
             spec("predicate", "in", spec("direct", "field", "s", index="first"), in_values=["x"], title="fs")]
    got = features_by_run(df, specs, ["k"], ["ts", "id"], "ts", "id", partition_by=["u"], bucket="hour")
    r = run_ids(df, ["k"], ["ts", "id"], partition_by=["u"], bucket="hour")
    ref = r.groupBy("u", "run_id").agg(*compile_features(specs, df.schema, order=F.struct("ts", "id")))
    cols = ["u", "run_id", "fv", "lv", "lh", "fs"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())


def test_null_partitions_and_times_keep_their_rows(spark):
    rows = [(1, None, "u", "a"), (2, datetime(2024, 1, 1), None, "a"), (3, datetime(2024, 1, 2), None, "a"),
            (4, datetime(2024, 1, 1), "u", "a"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, u string, k string")
    for bucket in ("day", "adaptive:day", None):
        got = {r.id: r.run_id for r in run_ids(df, ["k"], ["ts", "id"], ["u"], bucket).collect()}
        assert got == {1: 0, 4: 0, 5: 0, 2: 1, 3: 1}
        assert shifted(df, "id", ["ts", "id"], ["u"], bucket).count() == 5
        assert suffix_any(df, df.k == "a", ["ts", "id"], ["u"], bucket).count() == 5
    f = features_by_run(df, [spec("direct", "count", "id", title="n")], ["k"], ["ts", "id"], "ts", "id", ["u"], "day")
    assert sum(r.n_elements for r in f.collect()) == 5
