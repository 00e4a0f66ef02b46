import math

from pyspark.sql import functions as F

from cadence.operators import synthesis as S


def _children(spark):
    return spark.createDataFrame(
        [(1, 10, 2.0, "a", True), (2, 10, 4.0, "a", None), (3, 10, None, "b", False), (4, 11, 5.0, None, True), (5, None, 9.0, "c", True)],
        "item int, sale int, price double, kind string, open boolean")


def test_numbers_are_aggregated_from_the_rows_and_not_once_for_each_distinct_count(spark):
    sales = spark.createDataFrame([(10,), (11,), (12,), (None,)], "sale int")
    root = S.Entity("sales", sales, "sale").add_child(S.Entity("items", _children(spark), "item"), "sale")
    df = S.synthesize(root, 1)
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["sale"]: r for r in df.collect()}
    assert (got[10]["SUM(items.price)"], got[10]["MEAN(items.price)"], got[10]["COUNT(items)"]) == (6.0, 3.0, 3)
    assert (got[10]["NUM_UNIQUE(items.kind)"], got[10]["NUM_UNIQUE(items.open)"], got[11]["NUM_UNIQUE(items.kind)"]) == (2, 2, 0)
    assert math.isclose(got[10]["STD(items.price)"], math.sqrt(2)) and got[11]["STD(items.price)"] is None
    assert [got[k]["COUNT(items)"] for k in (12, None)] == [0, 0] and got[None]["SUM(items.price)"] is None
    assert df.columns == ["sale", *[f"{a}(items.price)" for a in ("SUM", "MEAN", "MAX", "MIN", "STD")],
                          "NUM_UNIQUE(items.kind)", "NUM_UNIQUE(items.open)", "COUNT(items)"]


def test_keys_of_many_rows_give_the_same(spark):
    x = _children(spark).unionByName(spark.range(500).select(
        F.lit(6).alias("item"), (F.col("id") % 3 + 20).cast("int").alias("sale"), F.col("id").cast("double").alias("price"),
        (F.col("id") % 7).cast("string").alias("kind"), F.lit(True).alias("open")))
    plain, some, all_hot = ([tuple(r) for r in S.roll_up(x, "sale", "items", {"item"}, n).orderBy("__fk").collect()]
                            for n in (10 ** 6, 100, 0))
    assert len(plain) == 5 and plain[-1][1] == sum(range(2, 500, 3))
    for other in (some, all_hot):
        assert all(a == b or math.isclose(a, b) for r, q in zip(plain, other, strict=True) for a, b in zip(r, q))
