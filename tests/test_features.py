"""Feature language: null-as-zero, NaN/log traps, index, nesting, predicates."""

import math
from datetime import datetime

import pytest

from cadence.functions.features import dedupe_specs, spec
from cadence.operators.runs import features_by_key


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(1, 1, datetime(2024, 1, 1, 10, 0, 5), None, "a"), (1, 2, datetime(2024, 1, 2, 11, 0, 6), 3.0, None),
            (1, 3, datetime(2024, 1, 3, 12, 0, 7), -1.0, "b"), (1, 4, datetime(2024, 1, 8, 13, 0, 8), 0.0, ""),
            (2, 5, datetime(2024, 2, 1, 1, 0, 0), None, "x"), (2, 6, datetime(2024, 2, 2, 2, 0, 0), 5.0, "y")]
    return spark.createDataFrame(rows, "g long, id long, ts timestamp, v double, s string")


def _feat(frame, s):
    out = features_by_key(frame, [dict(s, title="f")], ["g"], order_by=["ts", "id"])
    return {r["g"]: r["f"] for r in out.collect()}


@pytest.mark.parametrize("name,expect1,expect2", [
    ("sum", 2.0, 5.0), ("max", 3.0, 5.0), ("min", -1.0, 0.0), ("mean", 0.5, 2.5),
    ("count", 4.0, 2.0), ("mode", 0.0, 0.0), ("std", math.sqrt(2.25), 2.5),
])
def test_null_as_zero(frame, name, expect1, expect2):
    got = _feat(frame, spec("direct", name, "v"))
    assert got[1] == pytest.approx(expect1) and got[2] == pytest.approx(expect2)


def test_log_negative_is_nan_and_zero_is_zero(frame):
    got = _feat(frame, spec("direct", "log", "v"))
    assert math.isnan(got[1])
    assert got[2] == pytest.approx(math.log(5.0) / 2)


def test_field_drops_nulls_and_isnot(frame):
    assert _feat(frame, spec("direct", "field", "v"))[1] == pytest.approx((3 - 1 + 0) / 3)
    assert _feat(frame, spec("direct", "isnot", "v"))[1] == pytest.approx(1 / 3)
    assert _feat(frame, spec("direct", "isnot", "s"))[1] == pytest.approx(1 / 3)


def test_datetime_ops(frame):
    assert _feat(frame, spec("direct", "day", "ts"))[1] == pytest.approx((1 + 2 + 3 + 8) / 4)
    assert _feat(frame, spec("direct", "weekday", "ts"))[1] == pytest.approx((0 + 1 + 2 + 0) / 4)
    assert _feat(frame, spec("direct", "hour", "ts"))[2] == pytest.approx(1.5)
    assert _feat(frame, spec("direct", "day", "v"))[1] == 0.0      # non-datetime -> 0


def test_index_first_last_and_nesting(frame):
    assert _feat(frame, spec("direct", "field", "v", index="last"))[1] == 0.0
    got = _feat(frame, spec("direct", "field", "v", index="first"))
    assert got[1] is None                                      # null first element
    nested = spec("direct", "month", spec("direct", "field", "ts", index="last"))
    assert _feat(frame, nested)[2] == 2.0
    assert _feat(frame, spec("direct", "std", spec("direct", "sum", "v")))[1] == 0.0
    assert _feat(frame, spec("direct", "count", spec("direct", "sum", "v")))[1] == 1.0


def test_predicates_and_binary(frame):
    assert _feat(frame, spec("predicate", "num_unique", spec("direct", "field", "s")))[1] == 3.0
    assert _feat(frame, spec("predicate", "in", spec("direct", "field", "s", index="first"),
                             in_values=["a"]))[1] == 1.0
    assert _feat(frame, spec("binary", left=spec("direct", "sum", "v"), op=">", right=2))[2] == 1.0
    assert _feat(frame, spec("binary", left=spec("direct", "count", "v"), op="!=", right=4))[1] == 0.0


def test_unknown_op_raises(frame):
    with pytest.raises(ValueError):
        _feat(frame, spec("direct", "minute", "ts"))


def test_dedupe_common_features():
    a = spec("direct", "sum", "v", title="t1")
    b = spec("direct", "max", "v", title="t2")
    out = dedupe_specs({"x": [a, b], "y": [a]})
    assert [s["title"] for s in out["common"]] == ["t1"]
    assert out["common"][0]["_targets"] == ["x", "y"]
    assert [s["title"] for s in out["x"]] == ["t2"] and out["y"] == []
