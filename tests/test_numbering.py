import random

import pytest
from pyspark.sql import functions as F

from cadence.functions.text import compose_vietnamese, normalize_ngram_chars
from cadence.operators.encodings import build_dictionary, encode
from cadence.operators.numbering import dense_numbers
from cadence.operators.runs import chunk_ids
from cadence.sources.chunks import ChunkedReader


def test_dense_numbers_follow_the_order_with_nulls_and_a_common_prefix(spark):
    vals = [f"same/prefix/{i:05d}" for i in range(3000)] + [None]
    random.Random(1).shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "v string").repartition(5)
    got = {r["v"]: r["n"] for r in dense_numbers(df, ["v"]).collect()}
    want = {v: i for i, v in enumerate([None, *sorted(v for v in vals if v)])}
    assert got == want


def test_dense_numbers_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(0,)] * 50, "v int").repartition(4)
    rows = dense_numbers(df, ["v"]).collect()
    assert sorted(r["n"] for r in rows) == list(range(100))
    assert all((r["n"] >= 50) == (r["v"] == 1) for r in rows)
    assert dense_numbers(df.limit(0), ["v"]).columns == ["v", "n"]
    assert dense_numbers(df.limit(0), ["v"]).count() == 0


def test_unseen_values_are_numbered_after_the_dictionary(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "v string")
    enc, full = encode(df, "v", build_dictionary(df.filter("v = 'b'"), "v"))
    assert {r["value"]: r["n"] for r in full.collect()} == {"b": 0, "a": 1, "c": 2}
    assert enc.filter("v is null").count() == 1


def test_chunks_in_order_again_and_again(spark):
    rows = [(i, (i * 7919) % 1013, float(i)) for i in range(1013)]
    df = spark.createDataFrame(rows, "id int, ts int, x double").repartition(6)
    r = ChunkedReader(df, ["ts"], 100)
    want = sorted(rows, key=lambda t: t[1])
    assert (len(r), r.rows) == (11, 1013)
    for _ in range(2):
        got = [[tuple(x) for x in c.collect()] for c in r]
        assert got == [want[i:i + 100] for i in range(0, 1013, 100)]
    chunk = {x["id"]: x["c"] for x in chunk_ids(df, 100, ["ts"], col="c").collect()}
    assert all(chunk[t[0]] == i for i, c in enumerate(got) for t in c)
    assert "GreaterThanOrEqual(__row" in r.chunk(3)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(IndexError):
        r.chunk(11)


def test_chunks_of_a_time_range_as_vectors_and_of_nothing(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i:02d} 00:00:00", 3.0, 4.0) for i in range(1, 11)], "id int, ts string, a double, b double") \
        .withColumn("ts", F.to_timestamp("ts"))
    r = ChunkedReader(df, ["id"], 4, ts="ts", start="2024-01-03", end="2024-01-09")
    got = [c.select("id", "features").collect() for c in r.vectors(["a", "b"], normalize=True)]
    assert [[x["id"] for x in c] for c in got] == [[3, 4, 5, 6], [7, 8]]
    assert got[0][0]["features"] == [0.6, 0.8]
    assert list(ChunkedReader(df.limit(0), ["id"])) == []


def test_vietnamese_pairs_and_ideograph_classes(spark):
    cases = {"á": "á", "́a": "́a", "á̀": "á̀", "xợ Ểỹ": "xợ Ểỹ",
             "ź": "ź", "": "", "plain": "plain", "\U0001F600ù\U0001F600": "\U0001F600ù\U0001F600", "ẹ": "ẹ",
             "̣": "̣"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", compose_vietnamese("t").alias("c")).collect()}
    assert got == {**cases, None: None}
    cjk = spark.createDataFrame([("漢字学",)], "t string").select(normalize_ngram_chars("t", cjk_classes={"漢": "一", "学": "一"}))
    assert cjk.first()[0] == "一字一"
