"""Scalar traps: 8-bit codes, epoch digit rules, NaN vs null vs Inf."""

import math
from datetime import datetime, timezone

from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import cleaning as B


def test_codes_roundtrip(spark):
    df = spark.createDataFrame([(i,) for i in (0, 5, 255, 256, 300)], "i long")
    rows = df.select("i", S.int_to_code("i").alias("c")).select("i", "c", S.code_to_int("c").alias("back")).collect()
    got = {r["i"]: (r["c"], r["back"]) for r in rows}
    assert got[0] == ("100000000", 0) and got[5] == ("100000101", 5)
    assert got[255] == ("111111111", 255) and got[256] == ("1100000000", 256)
    assert got[300][0] == "1" + format(300, "b") and got[300][1] == 300


def test_epoch_by_digits(spark):
    ms = 1_704_067_200_123          # 2024-01-01 00:00:00.123 UTC, 13 digits
    df = spark.createDataFrame([(ms,), (ms * 10,), (1_704_067_200,)], "v long")
    got = [r[0] for r in df.select(S.epoch_us(S.epoch_by_digits("v"))).collect()]
    assert got[0] == 1_704_067_200_123_000 and got[1] == 1_704_067_200_123_000
    assert got[2] == 17_040_672_000_000            # 10 digits: divisor 100


def test_timespan_and_epoch_ms(spark):
    df = spark.createDataFrame([("1:30:15.5",)], "s string")
    assert df.select(S.parse_timespan("s")).first()[0] == 5415.5
    t = spark.createDataFrame([(1_704_067_200_123,)], "m long").select(S.epoch_ms_to_ts("m")).first()[0]
    assert t.replace(tzinfo=timezone.utc) == datetime(2024, 1, 1, 0, 0, 0, 123000, tzinfo=timezone.utc) or \
        t == datetime(2024, 1, 1, 0, 0, 0, 123000)


def test_floats_null_nan_inf(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (4, float("-inf")), (5, 2.0)],
                               "id long, x double")
    inf_null = {r["id"]: r["x"] for r in B.inf_to_null(df, ["x"]).collect()}
    assert inf_null[3] is None and inf_null[4] is None and math.isnan(inf_null[2])
    clean = {r["id"]: r["x"] for r in B.cleanup_na(df, ["x"]).collect()}
    assert clean[1] == 0.0 and clean[3] == 0.0 and math.isnan(clean[2])      # NaN kept
    n2n = {r["id"]: r["x"] for r in B.nan_to_num(df, ["x"]).collect()}
    assert n2n[2] == 0.0 and n2n[3] == 1.7976931348623157e308 and n2n[4] == -1.7976931348623157e308
    assert [r["id"] for r in B.dropna_any(df).collect()] == [3, 4, 5]


def test_phone_and_null_tokens(spark):
    df = spark.createDataFrame([("+1 (743) 555-3824",), ("call me",), ("1",)], "s string")
    assert [r[0] for r in df.select(S.is_phone("s")).collect()] == [True, False, False]
    t = spark.createDataFrame([("a",), ("NULL",), ("null",), ("",), (None,), ("NA",)], "s string")
    assert [r[0] for r in B.drop_null_tokens(t, ["s"]).collect()] == ["a", "NA"]
    assert B.drop_null_tokens(t, ["missing"]).count() == 0
    assert t.select(F.count("s")).first()[0] == 5
