"""Registered queries that show operators' own output: source registry, target
frames, fixed-order vectors, code strings, arrays, column types, linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import features
from cadence.functions import scalars as H
from cadence.functions.features import compile_features, spec
from cadence.operators import cleaning as B
from cadence.operators import ml as L
from cadence.operators import profiling as J
from cadence.operators import runs, targets
from cadence.plans import q_text
from cadence.plans.registry import register, table
from cadence.sources import readers

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_WHOLE = " AND ".join(f"{c} IS NOT NULL" for c in _CUSTOMER)


@register("source_registry", f"""
SELECT 'frame' AS kind, c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT 'file', c_custkey, c_name, c_nationkey, round(c_acctbal, 6), c_mktsegment FROM customer WHERE {_WHOLE}
""")
def q_source_registry(spark, sf_dir):
    """A4/A5: the same table through two readers of the registry."""
    frame = readers.read_source(spark, "frame", table(spark, sf_dir, "customer"))
    file = readers.read_source(spark, "file", f"{sf_dir.rstrip('/')}/customer.parquet")
    out = [x.select(F.lit(k).alias("kind"), *_CUSTOMER).withColumn("c_acctbal", F.round("c_acctbal", 6))
           for k, x in (("frame", frame), ("file", file))]
    return out[0].unionByName(out[1])


@register("target_frames", """
SELECT 'features' AS part, o_orderkey, o_custkey, CAST(0 AS DOUBLE) AS other_target, CAST(NULL AS DOUBLE) AS o_totalprice
FROM orders
UNION ALL
SELECT 'values', NULL, NULL, NULL, round(o_totalprice, 6) FROM orders
""")
def q_target_frames(spark, sf_dir):
    """Both frames of the split; the absent sibling target starts at zero."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o = targets.init_targets(o.withColumn("target_value_o_totalprice", F.col("o_totalprice")),
                             ["o_totalprice", "o_orderstatus"])
    feats, vals = targets.split_targets(o, ["o_totalprice"])
    feats = feats.withColumnRenamed("target_value_o_orderstatus", "other_target").withColumn("part", F.lit("features"))
    vals = vals.select(F.lit("values").alias("part"), F.round("o_totalprice", 6).alias("o_totalprice"))
    return feats.unionByName(vals, allowMissingColumns=True)


@register("feature_values", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(l_quantity, 0) AS f0,
       CAST(0 AS DOUBLE) AS f1, coalesce(l_discount, 0) AS f2, CAST(3 AS BIGINT) AS width
FROM lineitem
""")
def q_feature_values(spark, sf_dir):
    """The vector in its fixed order, an absent column as zero."""
    x = B.feature_values(table(spark, sf_dir, "lineitem"), ["l_quantity", "no_such_column", "l_discount"])
    return x.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                    *[F.col("features")[i].alias(f"f{i}") for i in range(3)],
                    F.size("features").cast("bigint").alias("width"))


@register("own_target", """
SELECT o_orderkey, round(o_totalprice, 6) AS target_value_o_totalprice,
       'o_orderkey,target_value_o_totalprice' AS kept, 'target_value_o_custkey' AS missing
FROM orders
""")
def q_own_target(spark, sf_dir):
    """Sibling targets dropped, and what a caller would then miss."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("target_value_o_totalprice"),
                                              F.col("o_custkey").alias("target_value_o_custkey"))
    own = B.drop_other_targets(o, "o_totalprice", ["o_totalprice", "o_custkey"])
    missing = B.missing_columns(own, o.columns)
    return own.select("o_orderkey", F.round("target_value_o_totalprice", 6).alias("target_value_o_totalprice"),
                      F.lit(",".join(own.columns)).alias("kept"), F.lit(",".join(missing)).alias("missing"))


@register("agg_codes", """
SELECT l_orderkey, round(avg(CAST(l_quantity AS BIGINT)), 6) AS codes,
       round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE), 6) AS "code．sum"
FROM lineitem GROUP BY l_orderkey
""")
def q_agg_codes(spark, sf_dir):
    """Code strings decode before they are aggregated; a dotted title is escaped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", H.int_to_code("l_quantity").alias("code"))
    specs = [spec("direct", "field", "code", title="codes"), spec("direct", "sum", "code", title="code.sum")]
    out = li.groupBy("l_orderkey").agg(*compile_features(specs, li.schema))
    return out.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("codes", "code．sum")])


@register("flatten_array", """
SELECT doc_id, CAST(len(string_split(replace(text, chr(10), ' '), ' ')) AS BIGINT) AS n_words,
       md5(replace(text, chr(10), ' ')) AS words_md5
FROM documents
""")
def q_flatten_array(spark, sf_dir):
    """Words by line, flattened to the words of the document."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.split(x, " "))
    x = table(spark, sf_dir, "documents").select("doc_id", H.flatten_array(lines).alias("w"))
    return x.select("doc_id", F.size("w").cast("bigint").alias("n_words"),
                    F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"))


@register("date_struct", """
SELECT event_id, CAST(epoch_ms(ts) AS BIGINT) AS ms FROM events
""")
def q_date_struct(spark, sf_dir):
    """H7: a ``{"$date": milliseconds}`` value becomes a timestamp."""
    ev = table(spark, sf_dir, "events")
    # the nearest millisecond, as the oracle's epoch_ms gives it (unix_millis cuts off)
    ms = F.floor((H.epoch_us("ts") + 500) / 1000).cast("bigint")
    x = ev.select("event_id", H.date_struct_to_ts(F.struct(ms.alias("$date"))).alias("t"))
    return x.select("event_id", F.unix_millis("t").alias("ms"))


_TYPES = [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "int")]


@register("column_types", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, "
    + (f"CAST(count(DISTINCT {c}) > 2 AS BIGINT) AS is_text FROM documents" if t == "str" else "CAST(0 AS BIGINT) AS is_text")
    for c, t in _TYPES))
def q_column_types(spark, sf_dir):
    """Type names of the columns and which are worth language detection."""
    d = table(spark, sf_dir, "documents")
    text = J.text_columns(d)
    return spark.createDataFrame([(c, t, int(c in text)) for c, t in J.resolve_types(d.schema).items()],
                                 "column string, type string, is_text bigint")


@register("linear_model", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
                  stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT round(b * sd, 4) AS importance,
       round((SELECT avg((a + b * l_quantity - l_extendedprice) * (a + b * l_quantity - l_extendedprice)) FROM lineitem) / 1e6, 6)
         AS mse_millions FROM s
""")
def q_linear_model(spark, sf_dir):
    """Evaluator and importance of a one-feature fit, which has a closed form."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    model, _ = L.search_model(li, ["l_quantity"], "label", "LinearRegression", {"regParam": [0.0]}, "regression", "l_quantity")
    (_, imp), = L.feature_importance(model, ["l_quantity"], li)
    mse = L.evaluator("regression").evaluate(model.transform(li))
    return spark.createDataFrame([(round(imp, 4), round(mse / 1e6, 6))], "importance double, mse_millions double")


@register("logistic_balance", """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(quality), 3) AS mean_p, round(avg(quality * n_chars / 1000.0), 3) AS mean_px
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL
""")
def q_logistic_balance(spark, sf_dir):
    """At the optimum the probabilities have the labels' mean and the labels' mean product with the feature."""
    from pyspark.ml.feature import VectorAssembler
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("x"))
    t = table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("quality").cast("double").alias("label"), "x").na.drop()
    t = VectorAssembler(inputCols=["x"], outputCol="features").transform(t)
    p = L.score(t, L.estimator("LogisticRegression", tol=1e-12, maxIter=300).fit(t), "proba")
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 3).alias("mean_p"),
                 F.round(F.avg(F.col("score") * F.col("x")), 3).alias("mean_px"))


@register("json_flatten_any", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "j.k",
  CASE WHEN event_id % 3 = 1 THEN event_type END AS "j.of.kind", CASE WHEN event_id % 3 = 1 THEN user_id END AS "j.of.user",
  CASE WHEN event_id % 3 = 2 THEN user_id END AS "j.list.0.n", CASE WHEN event_id % 3 = 2 AND event_id % 2 = 0 THEN event_id END AS "j.list.1.n"
FROM events
""")
def q_json_flatten_any(spark, sf_dir):
    """H8: keys differ by row and nobody gives a schema; nested objects and arrays become columns."""
    ev = table(spark, sf_dir, "events")
    bare = F.substring("props", 2, 1_000_000)
    of = F.format_string('{"of": {"kind": "%s", "user": %d}, ', "event_type", "user_id")
    one = F.format_string('{"n": %d}', "user_id")
    two = F.when(F.col("event_id") % 2 == 0, F.format_string(', {"n": %d}', "event_id")).otherwise("")
    j = F.when(F.col("event_id") % 3 == 1, F.concat(of, bare)).when(
        F.col("event_id") % 3 == 2, F.concat(F.lit('{"list": ['), one, two, F.lit("], "), bare)).otherwise(F.col("props"))
    return H.flatten_any_json(ev.select("event_id", j.alias("j")), "j")


@register("collection_fields", """
WITH v AS (SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL),
r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS n FROM v)
SELECT p_partkey, p_size, """ + ", ".join(f"CAST((n >> {7 - i}) & 1 AS INTEGER) AS p_brand{i}" for i in range(8)) + """
FROM part JOIN r ON p_brand = value
""")
def q_collection_fields(spark, sf_dir):
    """A collection read with field flags; the encoded field comes as the bits of its code."""
    import uuid

    from cadence.operators import encodings
    from cadence.session import scratch_path
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), "p_partkey", "p_brand", F.col("p_size").cast("int"))
    path = scratch_path(spark, f"coll-{uuid.uuid4().hex[:12]}")
    part.write.parquet(path)
    brands = encodings.build_dictionary(part, "p_brand")
    return readers.read_collection(spark, path, ["p_partkey", {"name": "p_brand", "type": "str", "encoding": "binaryintid"}],
                                   dictionaries={"p_brand": brands})


@register("run_groups_column_key", """
WITH e AS (SELECT event_id, user_id, ts, floor(value / 20) AS k FROM events),
c AS (SELECT *, CASE WHEN k IS NOT DISTINCT FROM lag(k) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run_id
FROM c
""")
def q_run_groups_column_key(spark, sf_dir):
    """Runs by a grouping function of the user's, any Column over the row."""
    ev = table(spark, sf_dir, "events")
    r = runs.run_ids(ev, [F.floor(F.col("value") / 20)], ["ts", "event_id"], partition_by=["user_id"], bucket="adaptive:day")
    return r.select("event_id", "user_id", "run_id")


def value_spread(run):
    """A custom feature: the spread of a run's values."""
    import numpy as np
    v = np.nan_to_num(run["value"], nan=0.0, posinf=np.inf, neginf=-np.inf)
    return {"user_id": run["user_id"][0], "run_id": run["run_id"][0], "value_spread": round(v.max() - v.min(), 6)}


@register("custom_feature_name", """
WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, round(max(coalesce(value, 0)) - min(coalesce(value, 0)), 6) AS value_spread
FROM r GROUP BY user_id, run_id
""")
def q_custom_feature_name(spark, sf_dir):
    """A custom feature without a title is named by its function."""
    title = features.custom_feature_title(value_spread)
    return runs.custom_run_features(table(spark, sf_dir, "events"), value_spread, f"user_id bigint, run_id bigint, {title} double",
                                    ["event_type"], ["ts", "event_id"], partition_by=["user_id"], bucket="adaptive:day", arrays=True)


@register("common_features", """
SELECT user_id, round(sum(coalesce(value, 0)), 6) AS total, CAST(count(*) AS DOUBLE) AS n, round(max(coalesce(value, 0)), 6) AS top,
  round(min(coalesce(value, 0)), 6) AS low, 'a,b' AS common_targets
FROM events GROUP BY user_id
""")
def q_common_features(spark, sf_dir):
    """Features that two targets share are computed once, under both targets."""
    total, n = features.spec("direct", "sum", "value", title="total"), features.spec("direct", "count", "value", title="n")
    by = features.dedupe_specs({"a": [total, n, features.spec("direct", "max", "value", title="top")],
                                "b": [total, features.spec("direct", "min", "value", title="low"), n]})
    shared = sorted({t for s in by["common"] for t in s["_targets"]})
    out = runs.features_by_key(table(spark, sf_dir, "events"), by["common"] + by["a"] + by["b"], ["user_id"])
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("total", "n", "top", "low")], F.lit(",".join(shared)).alias("common_targets"))


@register("ensemble_importance", """
WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_slope(-l_extendedprice, l_quantity) AS b, stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT round((0.75 * a * sd + 0.25 * b * sd) / 2, 3) AS importance FROM s
""")
def q_ensemble_importance(spark, sf_dir):
    """Mean of weight times importance over two fits, one with a falling slope."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    fit = lambda d: L.search_model(d, ["l_quantity"], "label", "LinearRegression", {"regParam": [0.0]}, "regression", "l_quantity")[0]
    (_, imp), = L.ensemble_importance([(0.75, fit(li)), (0.25, fit(li.withColumn("label", -F.col("label"))))], ["l_quantity"], li)
    return spark.createDataFrame([(round(imp, 3),)], "importance double")


@register("profile_languages", "WITH " + q_text._d_profiles() + "," + q_text._d_detect(
    "(SELECT conv_id * 1000000 + turn * 10 + 1 AS cid, text FROM conversations UNION ALL "
    "SELECT conv_id * 1000000 + turn * 10 + 2, role FROM conversations)", "cid", "text") + """
SELECT CASE WHEN k % 10 = 1 THEN 'text' ELSE 'role' END AS "column", lang AS key, CAST(count(*) AS DOUBLE) AS value, 'multiclass' AS target_type
FROM det GROUP BY ALL
""")
def q_profile_languages(spark, sf_dir):
    """The languages part of a table's summary: its text columns that are not binary."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("cid"), "role", "text")
    p = J.profile(c, languages=q_text._probs(spark, sf_dir), id_col="cid")
    return p.filter("kind = 'languages'").select("column", "key", "value", "target_type")
