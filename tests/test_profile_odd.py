"""Profiles of columns that have no histogram."""

from cadence.operators import profiling as J


def test_infinite_nan_and_empty_columns(spark):
    rows = [(1.5, None, float("nan"), "a"), (float("inf"), None, float("nan"), "b"),
            (1.5, None, None, "a"), (-2.0, None, None, None)]
    df = spark.createDataFrame(rows, "v double, nothing int, nan double, s string")
    got = {(r["column"], r["kind"], r["key"]): (r["value"], r["target_type"]) for r in J.profile(df).collect()}
    assert got[("v", "freq", "1.5")] == (0.5, "continuous")
    assert got[("v", "freq", "Infinity")] == (0.25, "continuous")
    assert got[("nothing", "hist", None)] == (None, "binary")
    assert got[("nan", "hist", None)][0] is None
    assert got[("s", "freq", "a")] == (0.5, "binary")


def test_third_value_decides_the_target_type(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (1, "z", None), (None, None, 2.0)], "i int, s string, d double")
    types = {c: J.target_type_col(df, c).first()[0] for c in df.columns}
    assert types == {"i": "binary", "s": "multiclass", "d": "binary"}
    assert J.text_columns(df) == ["s"]


def test_heavy_tail_has_a_histogram(spark):
    df = spark.range(200).selectExpr("CASE WHEN id = 199 THEN 1e6 ELSE CAST(id AS DOUBLE) END AS v")
    h = J.hist(df, "v").agg({"bin": "max", "density": "sum"}).first()
    assert h["max(bin)"] > 1000


def test_exact_quantiles_in_many_rounds(spark, monkeypatch):
    """Small brackets force many rounds; ties, far values and negative ones."""
    import numpy as np
    monkeypatch.setattr(J, "BRACKET", 3)
    monkeypatch.setattr(J, "ACCURACY", 4)
    rng = np.random.default_rng(2)
    cols = {"ties": rng.integers(0, 4, 300).astype(float), "tail": np.exp(rng.normal(0, 40, 300)) * rng.choice([-1, 1], 300),
            "plain": rng.normal(0, 1, 300), "one": np.full(300, 7.0)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(300)], [f"{c} x" for c in cols])
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = J.exact_quantiles_of(df, {f"{c} x": probs for c in cols})
    for c, v in cols.items():
        assert np.allclose(got[f"{c} x"][0], np.quantile(v, probs), rtol=1e-12), c


def test_far_values_fall_back_to_frequencies(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id = 999 THEN 1e15 ELSE CAST(id % 10 AS DOUBLE) END AS v")
    got = {(r["column"], r["kind"]) for r in J.profile(df).collect()}
    assert got == {("v", "freq")}
