"""Registered queries: target picking / as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.features import spec
from cadence.operators import runs, targets
from cadence.plans.registry import register, table

AFTER_1H = {"column": "value", "constraints": [
    {"type": "time", "key": "ts", "after": {"hours": 1}}, {"key": "user_id"}]}


def _ev(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@register("target_after", """
SELECT e.event_id,
       round(CASE WHEN r.event_id IS NULL THEN e.value ELSE r.value END, 6) AS target_value_value
FROM events e ASOF LEFT JOIN events r
  ON e.user_id = r.user_id AND e.ts + INTERVAL 1 HOUR <= r.ts
""")
def q_target_after(spark, sf_dir):
    out = targets.pick_targets(_ev(spark, sf_dir), [AFTER_1H], id_col="event_id")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))


@register("target_after_keyless", """
SELECT e.event_id,
       CASE WHEN r.event_id IS NULL THEN e.event_type ELSE r.event_type END AS target_value_event_type
FROM events e ASOF LEFT JOIN events r
  ON e.ts + INTERVAL 30 MINUTE + INTERVAL 90 SECOND <= r.ts
""")
def q_target_after_keyless(spark, sf_dir):
    t = {"column": "event_type", "constraints": [
        {"type": "time", "key": "ts", "after": {"hours": 0.5, "seconds": 90}}]}
    out = targets.pick_targets(_ev(spark, sf_dir), [t], id_col="event_id")
    return out.select("event_id", "target_value_event_type")


@register("target_before", """
WITH h AS (SELECT user_id, arg_min(value, ts) AS v, min(ts) AS t FROM events GROUP BY user_id)
SELECT e.event_id,
       round(CASE WHEN h.t <= e.ts - INTERVAL 2 HOUR THEN h.v ELSE e.value END, 6) AS target_value_value
FROM events e JOIN h USING (user_id)
""")
def q_target_before(spark, sf_dir):
    t = {"column": "value", "constraints": [
        {"type": "time", "key": "ts", "before": {"hours": 2}}, {"key": "user_id"}]}
    out = targets.pick_targets(_ev(spark, sf_dir), [t], id_col="event_id")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))


@register("target_before_nearest", """
SELECT e.event_id,
       round(CASE WHEN r.event_id IS NULL THEN e.value ELSE r.value END, 6) AS target_value_value
FROM events e ASOF LEFT JOIN events r
  ON e.user_id = r.user_id AND e.ts - INTERVAL 2 HOUR >= r.ts
""")
def q_target_before_nearest(spark, sf_dir):
    t = {"column": "value", "constraints": [
        {"type": "time", "key": "ts", "before": {"hours": 2}}, {"key": "user_id"}]}
    out = targets.pick_targets(_ev(spark, sf_dir), [t], id_col="event_id", mode="nearest")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))


@register("target_equality", """
WITH f AS (SELECT event_type, arg_min(value, event_id) AS v FROM events GROUP BY event_type)
SELECT e.event_id, round(f.v, 6) AS target_value_value
FROM events e JOIN f USING (event_type)
""")
def q_target_equality(spark, sf_dir):
    t = {"column": "value", "constraints": [{"key": "event_type"}]}
    out = targets.pick_targets(_ev(spark, sf_dir), [t], id_col="event_id")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))


@register("target_own", """
SELECT event_id, round(value, 6) AS target_value_value FROM events
""")
def q_target_own(spark, sf_dir):
    out = targets.pick_targets(_ev(spark, sf_dir), [{"column": "value", "constraints": []}],
                               id_col="event_id")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))


MATRIX_SPECS = [spec("direct", "sum", "value", title="total_value"),
                spec("direct", "count", "value", title="n_values"),
                spec("direct", "hour", "ts", index="first", title="start_hour")]


@register("feature_matrix", """
WITH t AS (
  SELECT e.event_id, e.user_id, e.ts, e.event_type, e.value,
         CASE WHEN r.event_id IS NULL THEN e.value ELSE r.value END AS tv
  FROM events e ASOF LEFT JOIN events r ON e.user_id = r.user_id AND e.ts + INTERVAL 1 HOUR <= r.ts),
c AS (
  SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM
                 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg
  FROM t),
r AS (
  SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id,
       round(sum(coalesce(value,0)), 6) AS total_value,
       round(CAST(count(*) AS DOUBLE), 6) AS n_values,
       round(CAST(hour(arg_min(ts, ts)) AS DOUBLE), 6) AS start_hour,
       round(arg_min(tv, ts), 6) AS target_value_value
FROM r GROUP BY user_id, run_id
""")
def q_feature_matrix(spark, sf_dir):
    """Per-user runs -> features + the as-of target of the run's first member."""
    ev = _ev(spark, sf_dir)
    feats = runs.features_by_run(ev, MATRIX_SPECS, keys=["event_type"], order_by=["ts", "event_id"],
                                 ts_col="ts", id_col="event_id", partition_by=["user_id"],
                                 bucket="adaptive:day")
    tv = targets.pick_targets(ev, [AFTER_1H], id_col="event_id") \
        .select(F.col("event_id").alias("first_id"), "target_value_value")
    out = feats.join(tv, on="first_id", how="left")
    return out.select("user_id", "run_id", *[F.round(c, 6).alias(c) for c in
                                             ("total_value", "n_values", "start_hour",
                                              "target_value_value")])


@register("split_targets", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS target_value_o_totalprice
FROM orders
""")
def q_split_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o = targets.init_targets(o.withColumn("target_value_o_totalprice", F.col("o_totalprice")),
                             ["o_totalprice", "o_orderstatus"])
    feats, vals = targets.split_targets(o, ["o_totalprice"])
    # features keep the key columns, zero-initialised sibling targets stay
    assert "target_value_o_orderstatus" in feats.columns
    return o.select("o_orderkey", "o_custkey",
                    F.round("target_value_o_totalprice", 6).alias("target_value_o_totalprice"))


@register("target_after_nulls", """
WITH e AS (SELECT event_id, ts, value, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS user_id FROM events),
k AS (SELECT *, coalesce(user_id, -1) AS k FROM e)
SELECT e.event_id, round(CASE WHEN r.event_id IS NULL THEN e.value ELSE r.value END, 6) AS target_value_value
FROM k e ASOF LEFT JOIN k r ON e.k = r.k AND e.ts + INTERVAL 1 HOUR <= r.ts
""")
def q_target_after_nulls(spark, sf_dir):
    e = _ev(spark, sf_dir)
    e = e.withColumn("user_id", F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END"))
    out = targets.pick_targets(e, [AFTER_1H], id_col="event_id")
    return out.select("event_id", F.round("target_value_value", 6).alias("target_value_value"))
