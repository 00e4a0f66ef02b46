"""As-of target picking: ties, null values, no match, keys, before modes."""

from datetime import datetime, timedelta

import pytest

from cadence.operators.targets import pick_targets

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, T0, "u", 1.0), (2, T0 + timedelta(hours=1), "u", None), (3, T0 + timedelta(hours=1), "u", 3.0),
            (4, T0 + timedelta(days=3), "u", 4.0), (5, T0, "v", 10.0), (6, T0 + timedelta(minutes=30), "v", 11.0)]
    return spark.createDataFrame(rows, "id long, ts timestamp, k string, value double")


def _tv(df):
    return {r["id"]: r["target_value_value"] for r in df.collect()}


def test_after_ties_null_and_own_value(frame):
    t = {"column": "value", "constraints": [{"type": "time", "key": "ts", "after": {"hours": 1}}, {"key": "k"}]}
    got = _tv(pick_targets(frame, [t], "id"))
    assert got[1] is None            # equal timestamps: lowest id (2) wins, its null value is kept
    assert got[2] == 4.0 and got[3] == 4.0   # next match is two days later (other bucket)
    assert got[4] == 4.0             # no later row: own value
    assert got[5] == 10.0 and got[6] == 11.0


def test_before_reference_and_nearest(frame):
    t = {"column": "value", "constraints": [{"type": "time", "key": "ts", "before": {"hours": 1}}, {"key": "k"}]}
    ref = _tv(pick_targets(frame, [t], "id"))
    assert ref[4] == 1.0 and ref[2] == 1.0 and ref[1] == 1.0  # earliest row of the key if early enough
    near = _tv(pick_targets(frame, [t], "id", mode="nearest"))
    assert near[4] is None           # latest earlier time has ids 2 and 3: id 2 (null value) wins
    assert near[2] == 1.0 and near[3] == 1.0
    assert near[1] == 1.0            # nothing before: own value


def test_key_only_and_missing_key(frame):
    got = _tv(pick_targets(frame, [{"column": "value", "constraints": [{"key": "k"}]}], "id"))
    assert got[4] == 1.0 and got[6] == 10.0
    with pytest.raises(ValueError):
        pick_targets(frame, [{"column": "value", "constraints": [{"key": "nope"}]}], "id")


def test_asof_adaptive_slices_equal_plain(spark):
    """A hot key's day is sliced; matches equal the unsliced as-of join."""
    from pyspark.sql import functions as F

    from cadence.functions.scalars import epoch_us
    from cadence.operators.targets import asof_join
    rows = [(i, T0 + timedelta(seconds=37 * i), "hot" if i % 5 else "cold", float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k string, value double")
    args = (df, df, ["k"], epoch_us("ts") + F.lit(600_000_000), epoch_us("ts"), F.col("id"),
            F.struct(F.col("value").alias("v")))
    a = {r["id"]: r["__hit"] for r in asof_join(*args, adaptive=False).collect()}
    b = {r["id"]: r["__hit"] for r in asof_join(*args, adaptive=True, target_rows=50).collect()}
    assert a == b and sum(v is not None for v in a.values()) > 1500
    c = {r["id"]: r["__hit"] for r in asof_join(*args[:3], epoch_us("ts") - F.lit(600_000_000), *args[4:],
                                                 direction="backward", adaptive=True, target_rows=50).collect()}
    d = {r["id"]: r["__hit"] for r in asof_join(*args[:3], epoch_us("ts") - F.lit(600_000_000), *args[4:],
                                                 direction="backward", adaptive=False).collect()}
    assert c == d


def test_asof_ties_keep_their_type_and_null_keys_match(spark):
    from datetime import datetime

    from cadence.operators.targets import pick_targets

    day = [datetime(2024, 1, d) for d in (1, 2, 5)]
    big = 2 ** 53
    rows = [(1, day[0], "u", 1.0), (big + 1, day[1], "u", 20.0), (big, day[1], "u", 10.0),
            (2, day[0], None, 2.0), (3, day[2], None, 30.0)]
    t = [{"column": "v", "constraints": [{"type": "time", "key": "ts", "after": {"hours": 1}}, {"key": "k"}]}]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "id long, ts timestamp, k string, v double")
        df = df.withColumn("id", df.id.cast(kind))
        got = {int(r.id): r.target_value_v for r in pick_targets(df, t, id_col="id").collect()}
        assert got[1] == 10.0 and got[2] == 30.0
