"""Prediction monitor (C7) against a brute-force scan on a dense fixture."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from cadence.operators import lookups

HOUR = 3_600_000_000


def _fixture(seed: int):
    rng = np.random.default_rng(seed)
    base = 1_700_000_000_000_000
    rows = []
    # key 1 is hot (most rows), many predictions per hour, integer values so
    # |v - a| == 20 ties (score == 400, not an alert) occur.
    for key, n in ((1, 600), (2, 80), (3, 15)):
        t = base + rng.integers(0, 6 * HOUR, n)
        t[: n // 10] = t[0]  # a flood of equal timestamps
        v = rng.integers(0, 60, n).astype(float)
        kind = rng.random(n) < 0.7
        rows += [(key, int(ti), float(vi), bool(ki)) for ti, vi, ki in zip(t, v, kind)]
    # predictions exactly on the band edges of one actual (both excluded)
    at = base + 4 * HOUR + 12345
    rows += [(2, at, 100.0, False), (2, at - HOUR, 0.0, True), (2, at - 2 * HOUR, 0.0, True),
             (2, at - HOUR - 1, 0.0, True)]
    df = pd.DataFrame(rows, columns=["user_id", "us", "value", "is_pred"])
    df["event_id"] = np.arange(len(df), dtype=np.int64)
    return df


def _brute(df: pd.DataFrame, threshold: float = 400.0) -> dict:
    preds = df[df.is_pred]
    out = {}
    for a in df[~df.is_pred].itertuples():
        c = preds[(preds.user_id == a.user_id) & (preds.us > a.us - 2 * HOUR) & (preds.us < a.us - HOUR)]
        c = c[(c.value - a.value) ** 2 > threshold]
        if len(c):
            best = c.sort_values(["us", "event_id"]).iloc[-1]
            out[a.event_id] = (int(best.event_id), float(best.value))
    return out


@pytest.mark.parametrize("seed,leaf_bits", [(1, 20), (2, 4), (3, 28)])
def test_monitor_matches_brute_force(spark, seed, leaf_bits):
    pdf = _fixture(seed)
    epoch = dt.datetime(1970, 1, 1)
    sdf = pdf.assign(ts=[epoch + dt.timedelta(microseconds=int(u)) for u in pdf.us])
    e = spark.createDataFrame(sdf[["event_id", "user_id", "ts", "value", "is_pred"]])
    got = lookups.monitor_predictions(e.filter("is_pred"), e.filter("not is_pred"), ["user_id"],
                                      ts="ts", value="value", id_col="event_id", leaf_bits=leaf_bits)
    got = {r.act_id: (r.pred_id, r.predicted) for r in got.collect()}
    want = _brute(pdf)
    assert len(want) > 50
    assert got == want
