"""Scaling, model families, search, scoring, reports and centroids.

Training and scoring use ``pyspark.ml`` (distributed); foreign single-machine
models are applied batch-wise through ``mapInPandas`` (Arrow). Reports are
aggregates; only one-row statistics reach the driver.
"""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.operators.cleaning import cleanup_na, missing_columns, nan_to_num, tail_rows


# ------------------------------------------------------------------ L2
def fit_minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Per-column (min, max) after NaN/Inf cleaning: one aggregate row."""
    x = nan_to_num(df.select(*cols), cols)
    r = x.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(cols)],
              *[F.max(c).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    return {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)}


def minmax_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - min) / (max - min); a constant column scales to 0 (not 0.5)."""
    x = nan_to_num(df, list(params))
    out = {}
    for c, (lo, hi) in params.items():
        rng = (hi - lo) if hi is not None and lo is not None else 0.0
        out[c] = F.lit(0.0) if not rng else (F.col(c) - F.lit(lo)) / F.lit(rng)
    return x.withColumns(out)


def minmax_unscale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """Inverse of ``minmax_scale``."""
    return df.withColumns({c: F.col(c) * F.lit((hi - lo) or 0.0) + F.lit(lo)
                           for c, (lo, hi) in params.items() if c in df.columns})


# ------------------------------------------------------------------ L5 / L6
def default_metric(task: str) -> str:
    return "mse" if task == "regression" else "accuracy"


def evaluator(task: str, label: str = "label", prediction: str = "prediction"):
    if task == "regression":
        return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName="mse")
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy")


_REG = {
    **{n: (R.LinearRegression, {}) for n in ("LinearRegression", "SGDRegressor")},
    "Ridge": (R.LinearRegression, {"elasticNetParam": 0.0, "regParam": 1.0}),
    "Lasso": (R.LinearRegression, {"elasticNetParam": 1.0, "regParam": 1.0}),
    "ElasticNet": (R.LinearRegression, {"elasticNetParam": 0.5, "regParam": 1.0}),
    "HuberRegressor": (R.LinearRegression, {"loss": "huber"}),
    "DecisionTreeRegressor": (R.DecisionTreeRegressor, {}),
    "RandomForestRegressor": (R.RandomForestRegressor, {}),
    "GradientBoostingRegressor": (R.GBTRegressor, {}),
    "BaggingRegressor": (R.RandomForestRegressor, {"featureSubsetStrategy": "all"}),
}
_CLS = {
    **{n: (C.LogisticRegression, {}) for n in ("LogisticRegression", "SGDClassifier", "Perceptron", "RidgeClassifier")},
    "LinearSVC": (C.LinearSVC, {}),
    "DecisionTreeClassifier": (C.DecisionTreeClassifier, {}),
    "RandomForestClassifier": (C.RandomForestClassifier, {}),
    "GradientBoostingClassifier": (C.GBTClassifier, {}),
    "BaggingClassifier": (C.RandomForestClassifier, {"featureSubsetStrategy": "all"}),
    "MultinomialNB": (C.NaiveBayes, {"modelType": "multinomial"}),
    "BernoulliNB": (C.NaiveBayes, {"modelType": "bernoulli"}),
    "GaussianNB": (C.NaiveBayes, {"modelType": "gaussian"}),
}
#: family whose penalty is cross-validated -> (family, penalties)
_CV = {
    "RidgeCV": ("Ridge", (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)),
    "LassoCV": ("Lasso", (0.001, 0.01, 0.1, 1.0, 10.0)),
    "ElasticNetCV": ("ElasticNet", (0.001, 0.01, 0.1, 1.0, 10.0)),
    "LogisticRegressionCV": ("LogisticRegression", (0.0, 0.001, 0.01, 0.1, 1.0)),
    "RidgeClassifierCV": ("RidgeClassifier", (0.001, 0.01, 0.1, 1.0, 10.0)),
}
ESTIMATORS = {**_REG, **_CLS, **{n: (_REG | _CLS)[f] for n, (f, _) in _CV.items()}}


def estimator(name: str, features: str = "features", label: str = "label", folds: int = 5, fold_col: str | None = None,
              penalties: list[float] | None = None, **params):
    """A ``pyspark.ml`` estimator for a model family name.

    A ``*CV`` family is a ``CrossValidator`` over its ``penalties`` with ``folds``
    folds, drawn by a fixed seed or given by ``fold_col`` (whole numbers from 0);
    its model is one of the family itself, fitted to all rows. A given ``regParam``
    leaves nothing to choose. ``linear_cv`` fits the linear families from one pass.
    """
    if name not in ESTIMATORS:
        raise ValueError(f"model family {name!r} has no distributed counterpart")
    cls, defaults = ESTIMATORS[name]
    one = cls(featuresCol=features, labelCol=label, **{**defaults, **params})
    if name not in _CV or "regParam" in params:
        return one
    family, usual = _CV[name]
    grid = ParamGridBuilder().addGrid(one.getParam("regParam"), list(penalties or usual)).build()
    return CrossValidator(estimator=one, estimatorParamMaps=grid, numFolds=folds, seed=7, parallelism=2,
                          evaluator=evaluator("regression" if family in _REG else "classification", label),
                          **({"foldCol": fold_col} if fold_col else {}))


# ------------------------------------------------------------------ L4
def search_model(df: DataFrame, feature_cols: list[str], label: str, family: str,
                 grid: dict[str, list], task: str, id_col: str, pilot: int | None = None, seed: int = 7):
    """L4: choose params on all rows, or on the first ``pilot`` rows by id if the
    caller sets it, and refit on all rows. Returns (fitted pipeline model, best params).
    """
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="skip")
    est = estimator(family, label=label)
    est = est.getEstimator() if isinstance(est, CrossValidator) else est
    pg = ParamGridBuilder()
    for k, vals in grid.items():
        pg = pg.addGrid(est.getParam(k), vals)
    tvs = TrainValidationSplit(estimator=est, estimatorParamMaps=pg.build(),
                               evaluator=evaluator(task, label), trainRatio=0.8, seed=seed)
    pilot_df = asm.transform(df if pilot is None else df.orderBy(id_col).limit(pilot))
    best = tvs.fit(pilot_df)
    bm = best.bestModel
    params = {p.name: bm.getOrDefault(p) for p in est.params if p.name in grid}
    final = Pipeline(stages=[asm, estimator(family, label=label, **params)]).fit(df)
    return final, params


# ------------------------------------------------------------------ L8
def fit_targets(df: DataFrame, feature_cols: list[str], targets: list[str], family: str = "LinearRegression",
                **params) -> tuple[dict, dict[str, tuple[float, float]]]:
    """One scaled model per target, and the ranges that scale features and targets.

    The ranges of all columns come from one pass; a row whose target is null
    does not train that target's model.
    """
    ranges = fit_minmax(df, [*feature_cols, *targets])
    x = minmax_scale(cleanup_na(df, feature_cols), ranges)
    asm = VectorAssembler(inputCols=feature_cols, outputCol="features")
    models = {t: Pipeline(stages=[asm, estimator(family, label=t, **params)]).fit(x.filter(F.col(t).isNotNull()))
              for t in targets}
    return models, ranges


def predict_all(df: DataFrame, models: dict, ranges: dict[str, tuple[float, float]], feature_cols: list[str],
                last: int | None = None, order_by: list[str] | None = None) -> DataFrame:
    """``predicted_<target>`` beside every row of ``df`` (or its ``last`` rows
    by ``order_by``): columns checked, tokens cleaned, features scaled by the
    fitted ranges, predictions scaled back by the target's.
    """
    missing = missing_columns(df, feature_cols)
    if missing:
        raise ValueError(f"missing columns {missing}")
    rows = df if last is None else tail_rows(df, last, order_by)
    # the row's own columns travel in a struct: scaling and the models only see the features
    x = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), *feature_cols)
    x = minmax_scale(cleanup_na(x, feature_cols), {c: ranges[c] for c in feature_cols})
    for t, model in models.items():
        lo, hi = ranges[t]
        x = model.transform(x).withColumn(f"predicted_{t}", F.col("prediction") * F.lit(hi - lo) + F.lit(lo)) \
            .select("__row", *feature_cols, *[f"predicted_{k}" for k in models if k == t or f"predicted_{k}" in x.columns])
    return x.select("__row.*", *[f"predicted_{t}" for t in models])


# ------------------------------------------------------------------ L7
def score(df: DataFrame, model, kind: str = "predict", out: str = "score") -> DataFrame:
    """``predict`` / ``proba`` (positive class) / ``log_proba`` with a
    fitted ``pyspark.ml`` model."""
    p = model.transform(df)
    if kind == "predict":
        return p.withColumn(out, F.col("prediction"))
    prob = vector_to_array("probability")[1]
    if kind == "proba":
        return p.withColumn(out, prob)
    if kind == "log_proba":
        return p.withColumn(out, F.log(prob))
    raise ValueError(f"unknown score kind {kind!r}")


def score_foreign(df: DataFrame, predict: Callable, feature_cols: list[str], out_schema: str,
                  out: str = "score", batch_rows: int = 1000) -> DataFrame:
    """L7 for a single-machine model object: ``predict(pandas.DataFrame) ->
    array-like`` applied to Arrow batches of ``batch_rows`` rows."""
    from cadence.session import ship_package

    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))

    def run(it):
        for pdf in it:
            pdf[out] = predict(pdf[feature_cols])
            yield pdf

    return df.mapInPandas(run, schema=out_schema)


# ------------------------------------------------------------------ L9 / L10
def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support (plus confusion counts
    via ``confusion``); accuracy is ``accuracy(df)``."""
    conf = confusion(df, label, prediction)
    tp = conf.filter(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = sup.join(pred, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return j.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def regression_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean absolute and mean squared error."""
    e = F.col(prediction) - F.col(label)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


# ------------------------------------------------------------------ L11
def feature_importance(model, names: list[str], df: DataFrame | None = None) -> list[tuple[str, float]]:
    """Tree importances, or coefficient x feature std for linear models, with
    the coefficient's sign (std from one aggregate over ``df``)."""
    stage = model.stages[-1] if hasattr(model, "stages") else model
    stage = getattr(stage, "bestModel", stage)
    if hasattr(stage, "featureImportances"):
        imp = list(stage.featureImportances.toArray())
    elif hasattr(stage, "coefficients"):
        coef = list(stage.coefficients.toArray())
        if df is not None:
            r = df.agg(*[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
            coef = [c * (r[f"s{i}"] or 0.0) for i, c in enumerate(coef)]
        imp = coef
    else:
        return [(n, float("nan")) for n in names]
    out = [(n, float(v)) for n, v in zip(names, imp)]
    out += [(n, float("nan")) for n in names[len(imp):]]
    return out


def ensemble_importance(models: list[tuple[float, object]], names: list[str], df: DataFrame | None = None) -> list[tuple[str, float]]:
    """Over weighted models ``(weight, model)``, the mean of weight times
    importance; models without importances do not count."""
    found = [(w, [v for _, v in feature_importance(m, names, df)]) for w, m in models]
    found = [(w, v) for w, v in found if not all(math.isnan(x) for x in v)]
    return [(n, sum(w * (0.0 if math.isnan(v[i]) else v[i]) for w, v in found) / len(found) if found else float("nan"))
            for i, n in enumerate(names)]


# ------------------------------------------------------------------ NearestCentroid
def nearest_centroid(train: DataFrame, test: DataFrame, vec: str, label: str, id_col: str) -> DataFrame:
    """Centroid (mean vector) per label from ``train``; each ``test`` vector
    gets the label of the closest centroid (Euclidean; ties -> lower label).

    Vectors are exploded to (id, position, value); centroids are a table of
    labels x dimensions (bounded), joined on position.
    """
    tr = train.select(F.col(label).alias("lbl"), F.posexplode(vec).alias("pos", "v"))
    cent = tr.groupBy("lbl", "pos").agg(F.avg(F.col("v").cast("double")).alias("c"))
    # labels x dimensions rows: AQE broadcasts from the measured size
    te = test.select(F.col(id_col).alias("id"), F.posexplode(vec).alias("pos", "v"))
    d = te.join(cent, "pos").groupBy("id", "lbl").agg(
        F.sum((F.col("v").cast("double") - F.col("c")) ** 2).alias("d2"))
    best = d.groupBy("id").agg(F.min_by("lbl", F.struct("d2", "lbl")).alias("pred"),
                               F.sqrt(F.min("d2")).alias("dist"))
    return best.withColumnRenamed("id", id_col)


def vote_average(df: DataFrame, prob_cols: list[str], out: str = "probability") -> DataFrame:
    """VotingClassifier (soft): average of the members' probability columns."""
    arrays = [vector_to_array(c) if not c.endswith("_arr") else F.col(c) for c in prob_cols]
    n = len(arrays)
    summed = arrays[0]
    for a in arrays[1:]:
        summed = F.zip_with(summed, a, lambda x, y: x + y)
    return df.withColumn(out, F.transform(summed, lambda x: x / F.lit(float(n))))
