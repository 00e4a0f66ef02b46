"""Registered queries: synthesis, scaling, training sets, models, reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cadence.operators import ml as L
from cadence.operators import synthesis as S
from cadence.operators.entity_graph import EntityGraph
from cadence.operators.linear_cv import fit_cross_validated
from cadence.plans.registry import register, table

_DEEP = {
    "sum_qty": "SUM(lineitem.l_quantity)",
    "mean_price": "MEAN(lineitem.l_extendedprice)",
    "max_disc": "MAX(lineitem.l_discount)",
    "std_tax": "STD(lineitem.l_tax)",
    "nu_flag": "NUM_UNIQUE(lineitem.l_returnflag)",
    "n_lines": "COUNT(lineitem)",
    "month": "MONTH(o_orderdate)",
    "weekday": "WEEKDAY(o_orderdate)",
}


@register("deep_features", """
WITH l AS (SELECT l_orderkey, sum(l_quantity) AS sum_qty, avg(l_extendedprice) AS mean_price,
                  max(l_discount) AS max_disc, stddev_samp(l_tax) AS std_tax,
                  count(DISTINCT l_returnflag) AS nu_flag, count(*) AS n_lines
           FROM lineitem GROUP BY l_orderkey),
x AS (SELECT o.o_orderkey, l.sum_qty, l.mean_price, l.max_disc, l.std_tax, l.nu_flag,
             coalesce(l.n_lines, 0) AS n_lines, month(o.o_orderdate) AS month, isodow(o.o_orderdate) - 1 AS weekday
      FROM orders o LEFT JOIN l ON o.o_orderkey = l.l_orderkey)
SELECT o_orderkey,
       round(coalesce(sum_qty, avg(sum_qty) OVER ()), 6) AS sum_qty,
       round(coalesce(mean_price, avg(mean_price) OVER ()), 6) AS mean_price,
       round(coalesce(max_disc, avg(max_disc) OVER ()), 6) AS max_disc,
       round(coalesce(std_tax, avg(std_tax) OVER ()), 6) AS std_tax,
       CAST(round(coalesce(nu_flag, avg(nu_flag) OVER ())) AS BIGINT) AS nu_flag,
       CAST(n_lines AS BIGINT) AS n_lines, CAST(month AS BIGINT) AS month, CAST(weekday AS BIGINT) AS weekday
FROM x
""")
def q_deep_features(spark, sf_dir):
    """L1: orders <- lineitem synthesis (aggregates per FK edge + datetime
    transforms + mean imputation); a subset of the generated columns is shown."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").drop("l_shipdate")
    root = S.Entity("orders", o, "o_orderkey").add_child(S.Entity("lineitem", li, "l_linenumber"), "l_orderkey")
    df = S.deep_features(root, depth=1)
    out = df.select("o_orderkey", *[F.col(f"`{src}`").alias(dst) for dst, src in _DEEP.items()])
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("sum_qty", "mean_price", "max_disc", "std_tax")],
                      F.round("nu_flag").cast("bigint").alias("nu_flag"),
                      *[F.col(c).cast("bigint").alias(c) for c in ("n_lines", "month", "weekday")])


_MM_COLS = ["l_quantity", "l_extendedprice", "l_discount"]
_MM_SQL = """
WITH s AS (SELECT min(l_quantity) a0, max(l_quantity) b0, min(l_extendedprice) a1, max(l_extendedprice) b1,
                  min(l_discount) a2, max(l_discount) b2 FROM lineitem)
"""


@register("minmax_scale", _MM_SQL + """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round((l_quantity - a0) / (b0 - a0), 6) AS l_quantity,
       round((l_extendedprice - a1) / (b1 - a1), 6) AS l_extendedprice,
       round((l_discount - a2) / (b2 - a2), 6) AS l_discount
FROM lineitem, s
""")
def q_minmax_scale(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_MM_COLS)
    p = L.fit_minmax(li, _MM_COLS)
    out = L.minmax_scale(li, p)
    return out.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                      *[F.round(c, 6).alias(c) for c in _MM_COLS])


@register("minmax_inverse", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 6) AS l_quantity,
       round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount FROM lineitem
""")
def q_minmax_inverse(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_MM_COLS)
    p = L.fit_minmax(li, _MM_COLS)
    back = L.minmax_unscale(L.minmax_scale(li, p), p)
    return back.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                       *[F.round(c, 6).alias(c) for c in _MM_COLS])


@register("training_set", """
SELECT o_orderstatus, o_orderpriority,
       CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year, CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month,
       CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day, CAST(hour(o_orderdate) AS BIGINT) AS o_orderdate_hour,
       CAST(minute(o_orderdate) AS BIGINT) AS o_orderdate_minute,
       round(o_totalprice, 6) AS target_value_o_totalprice
FROM orders WHERE o_orderdate >= TIMESTAMP '1993-01-01'
""")
def q_training_set(spark, sf_dir):
    """L3 on orders: bounded read, cleaning, datetime expansion, target split."""
    o = table(spark, sf_dir, "orders")
    feats, vals, full = S.training_set(o, ["o_totalprice"], ids=["o_orderkey"], keys=["o_custkey"],
                                       ts="o_orderdate", start="1993-01-01")
    out = full.select(*[c for c in feats.columns], "target_value_o_totalprice")
    return out.select("o_orderstatus", "o_orderpriority",
                      *[F.col(c).cast("bigint").alias(c) for c in out.columns if c.startswith("o_orderdate_")],
                      F.round("target_value_o_totalprice", 6).alias("target_value_o_totalprice"))


_CLS_SQL = """
WITH x AS (SELECT l.quality AS label, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction
           FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT label, prediction, count(*) AS n FROM x GROUP BY ALL),
sup AS (SELECT label AS cls, sum(n) AS support FROM c GROUP BY 1),
pr AS (SELECT prediction AS cls, sum(n) AS predicted FROM c GROUP BY 1),
tp AS (SELECT label AS cls, n AS tp FROM c WHERE label = prediction),
j AS (SELECT coalesce(sup.cls, pr.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
             coalesce(tp, 0) AS tp FROM sup FULL JOIN pr ON sup.cls = pr.cls
             LEFT JOIN tp ON tp.cls = coalesce(sup.cls, pr.cls)),
m AS (SELECT cls, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
             CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM j)
"""


def _cls_frame(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lab.join(d, "doc_id").select(F.col("quality").alias("label"),
                                        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"))


@register("classification_report", _CLS_SQL + """
SELECT CAST(cls AS BIGINT) AS cls, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
""")
def q_classification_report(spark, sf_dir):
    rep = L.classification_report(_cls_frame(spark, sf_dir))
    return rep.select(F.col("cls").cast("bigint").alias("cls"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


@register("confusion_accuracy", """
WITH x AS (SELECT l.quality AS label, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction
           FROM labels l JOIN documents d USING (doc_id))
SELECT CAST(label AS BIGINT) AS label, CAST(prediction AS BIGINT) AS prediction, CAST(count(*) AS BIGINT) AS n,
       round((SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM x), 6) AS accuracy
FROM x GROUP BY ALL
""")
def q_confusion_accuracy(spark, sf_dir):
    x = _cls_frame(spark, sf_dir)
    acc = L.accuracy(x).select(F.round("accuracy", 6).alias("accuracy")).scalar()
    c = L.confusion(x)
    return c.select(F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("prediction"),
                    F.col("n").cast("bigint").alias("n"), acc.alias("accuracy"))


@register("regression_report", """
WITH x AS (SELECT l.l_extendedprice AS label, l.l_quantity * p.p_retailprice AS prediction
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT round(avg(abs(prediction - label)), 6) AS mae, round(avg((prediction - label) * (prediction - label)), 4) AS mse FROM x
""")
def q_regression_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part")
    x = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    r = L.regression_report(x)
    return r.select(F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"))


@register("nearest_centroid", """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label AS lbl, pos, avg(CAST(v AS DOUBLE)) AS c FROM x GROUP BY ALL),
d AS (SELECT x.vec_id, c.lbl, sum((CAST(x.v AS DOUBLE) - c.c) * (CAST(x.v AS DOUBLE) - c.c)) AS d2
      FROM x JOIN c USING (pos) GROUP BY ALL)
SELECT vec_id, CAST(arg_min(lbl, (d2, lbl)) AS BIGINT) AS pred, round(sqrt(min(d2)), 6) AS dist FROM d GROUP BY vec_id
""")
def q_nearest_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    r = L.nearest_centroid(e, e, "embedding", "label", "vec_id")
    return r.select("vec_id", F.col("pred").cast("bigint").alias("pred"), F.round("dist", 6).alias("dist"))


_FEATS = ["l_quantity", "l_discount", "l_tax"]


def _fit(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *_FEATS) \
        .withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    model, params = L.search_model(li, _FEATS, "l_extendedprice", "LinearRegression",
                                   {"regParam": [0.0, 0.1, 1.0]}, "regression", "rid")
    return li, model, params


@register("model_search")
def q_model_search(spark, sf_dir):
    """Pilot-then-refit linear model; predictions for every row
    (iterative solver: rows-only check)."""
    li, model, _ = _fit(spark, sf_dir)
    return L.score(li, model).select("l_orderkey", "l_linenumber", F.round("score", 4).alias("prediction"))


@register("batch_scoring_proba")
def q_batch_scoring_proba(spark, sf_dir):
    """L7 probability of the positive class from a distributed logistic model."""
    from pyspark.ml.feature import VectorAssembler
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    x = VectorAssembler(inputCols=["n_chars"], outputCol="features").transform(
        lab.join(d, "doc_id").withColumn("label", F.col("quality").cast("double")))
    m = L.estimator("LogisticRegression").fit(x)
    return L.score(x, m, "proba").select("doc_id", F.round("score", 6).alias("p_quality"))


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    """|coef| x std importances of the searched model, as rows."""
    li, model, _ = _fit(spark, sf_dir)
    imp = L.feature_importance(model, _FEATS, li)
    return spark.createDataFrame([(n, float(v)) for n, v in imp], "feature string, importance double")


@register("predict_all", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS a1,
                  regr_slope(l_tax, l_quantity) AS b2, regr_intercept(l_tax, l_quantity) AS a2 FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(a1 + b1 * l_quantity, 4) AS predicted_l_extendedprice,
       round(a2 + b2 * l_quantity, 6) AS predicted_l_tax
FROM lineitem, s
""")
def q_predict_all(spark, sf_dir):
    """Two targets from one scaled feature, a row per line; least squares has a closed form."""
    li = table(spark, sf_dir, "lineitem")
    both = ["l_extendedprice", "l_tax"]
    models, ranges = L.fit_targets(li.select("l_quantity", *both), ["l_quantity"], both)
    out = L.predict_all(li.select("l_orderkey", "l_linenumber", "l_quantity"), models, ranges, ["l_quantity"])
    return out.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                      F.round("predicted_l_extendedprice", 4).alias("predicted_l_extendedprice"),
                      F.round("predicted_l_tax", 6).alias("predicted_l_tax"))


_RIDGE_PENALTIES = [0.1, 10.0, 1000.0, 100000.0]


@register("ridge_cv", """
WITH x AS (SELECT l_orderkey % 5 AS f, l_quantity AS a, l_tax AS b, l_extendedprice / 1000 AS y FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL),
folds AS (SELECT DISTINCT f FROM x UNION ALL SELECT -1),
t AS (SELECT g.f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, count(*) * covar_pop(a, a) AS saa,
             count(*) * covar_pop(a, b) AS sab, count(*) * covar_pop(b, b) AS sbb, count(*) * covar_pop(a, y) AS say,
             count(*) * covar_pop(b, y) AS sby FROM folds g JOIN x ON x.f <> g.f GROUP BY g.f),
p AS (SELECT CAST(unnest([0.1, 10, 1000, 100000]) AS DOUBLE) AS p),
w AS (SELECT f, p, ma, mb, my, ((sbb + p) * say - sab * sby) / ((saa + p) * (sbb + p) - sab * sab) AS wa,
             ((saa + p) * sby - sab * say) / ((saa + p) * (sbb + p) - sab * sab) AS wb FROM t, p),
e AS (SELECT w.p, w.f, avg((y - (my - wa * ma - wb * mb) - wa * a - wb * b) ** 2) AS e FROM w JOIN x ON w.f = x.f GROUP BY ALL),
m AS (SELECT p, avg(e) AS mse FROM e GROUP BY p),
best AS (SELECT p FROM m ORDER BY mse, p DESC LIMIT 1)
SELECT m.p AS penalty, round(mse, 6) AS mse, m.p = best.p AS chosen,
       CASE WHEN m.p = best.p THEN round(wa, 6) END AS coef_quantity, CASE WHEN m.p = best.p THEN round(wb, 6) END AS coef_tax,
       CASE WHEN m.p = best.p THEN round(my - wa * ma - wb * mb, 6) END AS intercept
FROM m, best JOIN w ON w.f = -1 AND w.p = m.p
""")
def q_ridge_cv(spark, sf_dir):
    """The squared penalty is chosen over five folds of orders, all from one pass."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", (F.col("l_extendedprice") / 1000).alias("y"))
    m = fit_cross_validated(x, ["l_quantity", "l_tax"], "y", "RidgeCV", fold=F.col("l_orderkey") % 5, penalties=_RIDGE_PENALTIES)
    rows = [(p, round(e, 6), p == m.penalty, *([round(v, 6) for v in (*m.coefficients[0], m.intercepts[0])] if p == m.penalty
                                               else [None] * 3)) for p, e in m.path]
    return spark.createDataFrame(rows, "penalty double, mse double, chosen boolean, coef_quantity double, coef_tax double, intercept double")


@register("lasso_cv", """
WITH x AS (SELECT o_orderkey % 5 AS f, CAST(year(o_orderdate) AS DOUBLE) AS a, o_totalprice / 1000 AS y FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
folds AS (SELECT DISTINCT f FROM x UNION ALL SELECT -1),
t AS (SELECT g.f, avg(a) AS ma, avg(y) AS my, covar_pop(a, a) AS saa, covar_pop(a, y) AS say FROM folds g JOIN x ON x.f <> g.f GROUP BY g.f),
p AS (SELECT CAST(unnest([0.001, 0.1, 1, 100]) AS DOUBLE) AS p),
w AS (SELECT f, p, ma, my, sign(say) * greatest(abs(say) - p, 0) / saa AS wa FROM t, p),
e AS (SELECT w.p, w.f, avg((y - (my - wa * ma) - wa * a) ** 2) AS e FROM w JOIN x ON w.f = x.f GROUP BY ALL),
m AS (SELECT p, avg(e) AS mse FROM e GROUP BY p),
best AS (SELECT p FROM m ORDER BY round(mse, 9), p DESC LIMIT 1)
SELECT m.p AS penalty, round(mse, 6) AS mse, round(CASE WHEN m.p = best.p THEN wa END, 6) AS coef_year FROM m, best JOIN w ON w.f = -1 AND w.p = m.p
""")
def q_lasso_cv(spark, sf_dir):
    """The absolute penalty is chosen over five folds; one that is large enough leaves no weight."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 1000).alias("y"))
    m = fit_cross_validated(x, ["year"], "y", "LassoCV", fold=F.col("o_orderkey") % 5, penalties=[0.001, 0.1, 1.0, 100.0])
    rows = [(p, round(e, 6), round(m.coefficients[0][0], 6) if p == m.penalty else None) for p, e in m.path]
    return spark.createDataFrame(rows, "penalty double, mse double, coef_year double")


@register("ridge_classifier_cv", """
WITH x AS (SELECT doc_id, quality, CAST(n_chars AS DOUBLE) AS a, CASE WHEN quality = 1 THEN 1.0 ELSE -1.0 END AS y
           FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
t AS (SELECT avg(a) AS ma, avg(y) AS my, count(*) * covar_pop(a, a) AS saa, count(*) * covar_pop(a, y) AS say FROM x)
SELECT CAST(quality AS BIGINT) AS label, CAST(CASE WHEN my + say / (saa + 10) * (a - ma) > 0 THEN 1 ELSE 0 END AS BIGINT) AS prediction,
       CAST(count(*) AS BIGINT) AS n FROM x, t GROUP BY ALL
""")
def q_ridge_classifier_cv(spark, sf_dir):
    """Quality by length, as a ridge classifier; one penalty is given, so that SQL can say which rows fall where."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    m = fit_cross_validated(x, ["n_chars"], "quality", "RidgeClassifierCV", id_col="doc_id", penalties=[10.0])
    done = m.transform(x.filter(F.col("quality").isNotNull() & F.col("n_chars").isNotNull()))
    return L.confusion(done, "quality").select(*[F.col(c).cast("bigint").alias(c) for c in ("label", "prediction", "n")])


_GRAPH = {
    "n_nations": "COUNT(nation)",
    "n_names": "NUM_UNIQUE(nation.n_name)",
    "n_customers": "SUM(nation.COUNT(customer))",
    "mean_of_balance": "MEAN(nation.MEAN(customer.c_acctbal))",
    "max_balance": "MAX(nation.MAX(supplier.s_acctbal))",
    "n_suppliers": "SUM(nation.COUNT(supplier))",
    "spread": "STD(nation.COUNT(supplier))",
    "most_orders": "MAX(nation.MAX(customer.COUNT(orders)))",
    "millions": "SUM(nation.SUM(customer.SUM(orders.o_totalprice)))",
    "month": "MIN(nation.MIN(customer.MAX(orders.MONTH(o_orderdate))))",
}


@register("entity_synthesis", """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, max(month(o_orderdate)) AS m FROM orders GROUP BY 1),
c AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS b, max(coalesce(o.n, 0)) AS most, sum(s) AS s, min(m) AS m
      FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1),
s AS (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS b FROM supplier GROUP BY 1),
n AS (SELECT n_regionkey, count(*) AS n_nations, count(DISTINCT n_name) AS n_names, sum(coalesce(c.n, 0)) AS n_customers, avg(c.b) AS mean_of_balance,
             max(s.b) AS max_balance, sum(coalesce(s.n, 0)) AS n_suppliers, stddev_samp(coalesce(s.n, 0)) AS spread, max(most) AS most_orders,
             sum(c.s) / 1e6 AS millions, min(m) AS month
      FROM nation LEFT JOIN c ON c_nationkey = n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey GROUP BY 1)
SELECT r_regionkey, CAST(r_name = 'ASIA' AS INTEGER) AS asia, round(CAST(coalesce(n_nations, 0) AS DOUBLE), 6) AS n_nations,
       """ + ", ".join(f"round(CAST(coalesce({c}, avg({c}) OVER ()) AS DOUBLE), 6) AS {c}" for c in _GRAPH if c != "n_nations") + """
FROM region LEFT JOIN n ON n_regionkey = r_regionkey
""")
def q_entity_synthesis(spark, sf_dir):
    """L1: regions from nations, customers, suppliers and orders, three relations deep, names as categories; a part of the columns is shown."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "orders")}
    g = EntityGraph().entity("region", t["region"], "r_regionkey").entity("nation", t["nation"], "n_nationkey") \
        .entity("customer", t["customer"], "c_custkey").entity("supplier", t["supplier"], "s_suppkey").entity("orders", t["orders"], "o_orderkey") \
        .relate("region", "r_regionkey", "nation", "n_regionkey").relate("nation", "n_nationkey", "customer", "c_nationkey") \
        .relate("nation", "n_nationkey", "supplier", "s_nationkey").relate("customer", "c_custkey", "orders", "o_custkey")
    df = g.features("region", 3)
    value = {dst: F.col(f"`{src}`").cast("double") for dst, src in _GRAPH.items()}
    value["millions"] = value["millions"] / 1e6
    return df.select("r_regionkey", F.col("`r_name = ASIA`").cast("int").alias("asia"), *[F.round(c, 6).alias(n) for n, c in value.items()])


@register("entity_synthesis_shared", """
WITH l AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
lp AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT s_suppkey, n_name AS nation_name, round(CAST(coalesce(l.n, 0) AS DOUBLE), 6) AS n_lines, round(l.q, 6) AS quantity,
       (SELECT count(*) FROM part p JOIN lp ON lp.l_partkey = p.p_partkey) AS parts_sold
FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
""")
def q_entity_synthesis_shared(spark, sf_dir):
    """L1: lines have two parents, suppliers and parts; a supplier also sees its nation's own columns."""
    t = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "part", "lineitem")}
    lines = t["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    g = EntityGraph().entity("nation", t["nation"], "n_nationkey").entity("supplier", t["supplier"], "s_suppkey") \
        .entity("part", t["part"], "p_partkey").entity("lineitem", lines, "l_orderkey") \
        .relate("nation", "n_nationkey", "supplier", "s_nationkey").relate("supplier", "s_suppkey", "lineitem", "l_suppkey") \
        .relate("part", "p_partkey", "lineitem", "l_partkey")
    sold = g.synthesize("part", 1).filter(F.col("`COUNT(lineitem)`") > 0).agg(F.count(F.lit(1)).alias("parts_sold"))
    df = g.synthesize("supplier", 1)
    return df.select("s_suppkey", F.col("`nation.n_name`").alias("nation_name"), F.round(F.col("`COUNT(lineitem)`").cast("double"), 6).alias("n_lines"),
                     F.round(F.col("`SUM(lineitem.l_quantity)`"), 6).alias("quantity"), sold.scalar().alias("parts_sold"))


@register("estimator_ridge_cv", """
SELECT CAST(0 AS DOUBLE) AS penalty, round(regr_slope(l_extendedprice * (1 - l_discount), l_extendedprice), 6) AS slope,
       round(regr_intercept(l_extendedprice * (1 - l_discount), l_extendedprice), 4) AS intercept FROM lineitem
""")
def q_estimator_ridge_cv(spark, sf_dir):
    """The family as an estimator of a pipeline; folds by order; the net price follows the price, so no penalty predicts best."""
    price = F.col("l_extendedprice").cast("double")
    x = table(spark, sf_dir, "lineitem").select((price * (1 - F.col("l_discount").cast("double"))).alias("y"), price.alias("x"),
                                                (F.col("l_orderkey") % 5).cast("int").alias("fold"))
    cv = L.estimator("RidgeCV", label="y", fold_col="fold", penalties=[0.0, 5.0, 50.0])
    m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), cv]).fit(x).stages[-1].bestModel
    row = (float(m.getRegParam()), float(m.coefficients[0]), float(m.intercept))
    return spark.createDataFrame([row], "penalty double, slope double, intercept double").select(
        "penalty", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))
