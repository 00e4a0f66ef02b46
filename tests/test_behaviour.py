"""Session durations (O1/O2) with bucketed next-event lookups vs a plain scan."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cadence.operators.behaviour import session_durations


@pytest.mark.parametrize("bucket", ["adaptive:hour", "hour", "minute"])
def test_session_durations_match_plain_scan(spark, bucket):
    rnd = random.Random(7)
    rows = []
    for i in range(2000):
        u = 1 if i % 7 else 2 + i % 3                     # user 1 is hot
        t = datetime(2024, 1, 1, 20) + timedelta(seconds=rnd.randrange(0, 8 * 3600))
        rows.append((i, t, u))
    rows += [(5000, rows[0][1], rows[0][2])]                # equal timestamp, id breaks the tie
    df = spark.createDataFrame(rows, "id long, ts timestamp, u long")
    b = F.floor(F.unix_micros("ts") / F.lit(60_000_000)) if bucket == "minute" else bucket
    got = {r["id"]: r["duration_s"] for r in session_durations(df, "u", "ts", "id", bucket=b).collect()}
    want = {}
    by = {}
    for i, t, u in rows:
        by.setdefault((u, t.date()), []).append((t, i))
    for evs in by.values():
        evs.sort()
        for (t, i), nxt in zip(evs, evs[1:] + [None]):
            want[i] = (nxt[0] - t).total_seconds() if nxt else 0.0
    assert got == want
