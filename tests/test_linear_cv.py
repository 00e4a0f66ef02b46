import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.operators.linear_cv import fit_cross_validated


def _data(n=400, seed=3, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + offset
    x[:, 2] += 0.5 * (x[:, 0] - offset)
    y = 2.0 * (x[:, 0] - offset) - 0.3 * (x[:, 1] - offset) + rng.normal(size=n) + offset
    return x, y, np.arange(n) % 4


def _frame(spark, x, y, fold):
    rows = [(int(f), *map(float, r), float(t)) for f, r, t in zip(fold, x, y)]
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, y double").repartition(5)


def _ridge(x, y, p):
    mx, my = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + p * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_ridge_as_fold_by_fold(spark, offset):
    x, y, fold = _data(offset=offset)
    pens = [0.1, 10.0, 1000.0]
    m = fit_cross_validated(_frame(spark, x, y, fold), ["a", "b", "c"], "y", "RidgeCV", fold=F.col("fold"), folds=4, penalties=pens)
    want = {}
    for p in pens:
        fits = [(f, *_ridge(x[fold != f], y[fold != f], p)) for f in range(4)]
        want[p] = np.mean([np.mean((y[fold == f] - x[fold == f] @ w - b) ** 2) for f, w, b in fits])
    assert dict(m.path) == pytest.approx(want, rel=1e-6)
    assert m.penalty == min(want, key=want.get)
    w, b = _ridge(x, y, m.penalty)
    assert m.coefficients[0] == pytest.approx(list(w), rel=1e-6)
    got = [r["prediction"] for r in m.transform(_frame(spark, x, y, fold)).orderBy("y").collect()]
    assert got == pytest.approx(list((x @ w + b)[np.argsort(y)]), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("family,share", [("LassoCV", 1.0), ("ElasticNetCV", 0.5)])
def test_absolute_penalty_meets_its_optimality_conditions(spark, family, share):
    x, y, fold = _data()
    m = fit_cross_validated(_frame(spark, x, y, fold), ["a", "b", "c"], "y", family, fold=F.col("fold"), folds=4)
    w = np.array(m.coefficients[0])
    left = (x - x.mean(axis=0)).T @ (y - y.mean() - (x - x.mean(axis=0)) @ w) / len(y) - m.penalty * (1 - share) * w
    for g, v in zip(left, w):
        assert abs(g) <= m.penalty * share + 1e-8
        if v:
            assert g == pytest.approx(np.sign(v) * m.penalty * share, abs=1e-8)
    assert len(m.path) == 100
    big = fit_cross_validated(_frame(spark, x, y, fold), ["a", "b", "c"], "y", family, fold=F.col("fold"), folds=4, penalties=[1e6])
    assert big.coefficients[0] == pytest.approx([0.0, 0.0, 0.0], abs=1e-6)


def test_classifier_of_three_classes(spark):
    rng = np.random.default_rng(5)
    centres = {"x": (0, 0), "y": (6, 0), "z": (0, 6)}
    rows = [(i, *(float(v) for v in rng.normal(size=2) + centres[c]), c) for i, c in enumerate("xyz" * 100)]
    df = spark.createDataFrame(rows + [(1000, None, 1.0, "x"), (1001, 1.0, 1.0, None)], "id int, a double, b double, c string")
    m = fit_cross_validated(df, ["a", "b"], "c", "RidgeClassifierCV", id_col="id")
    done = m.transform(df)
    assert m.classes == ["x", "y", "z"]
    assert done.filter("c = prediction").count() > 290
    assert done.filter("id = 1000 and prediction is null").count() == 1


def test_rows_that_do_not_count_and_tables_that_cannot_be_fitted(spark):
    x, y, fold = _data(60)
    df = _frame(spark, x, y, fold)
    dirty = df.unionByName(spark.createDataFrame(
        [(0, None, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0), (2, 1.0, float("inf"), 1.0, 1.0), (3, 1.0, 1.0, 1.0, None),
         (9, 1.0, 1.0, 1.0, 1.0)], df.schema))
    fit = lambda d: fit_cross_validated(d, ["a", "b", "c"], "y", "RidgeCV", fold=F.col("fold"), folds=4)
    a, b = fit(df), fit(dirty)
    assert a.penalty == b.penalty and a.coefficients[0] == pytest.approx(b.coefficients[0])
    with pytest.raises(ValueError, match="no complete row"):
        fit(df.limit(0))
    with pytest.raises(ValueError, match="fewer than two folds"):
        fit(df.filter("fold = 1"))
    with pytest.raises(ValueError, match="id column"):
        fit_cross_validated(df, ["a"], "y", "RidgeCV")
    with pytest.raises(ValueError, match="not a cross-validated"):
        fit_cross_validated(df, ["a"], "y", "Ridge", id_col="a")
