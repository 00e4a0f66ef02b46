"""Registered queries: lookups, caches, monitoring, set ops, top-1 (C4-C10, G, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.features import spec
from cadence.functions.scalars import epoch_us
from cadence.operators import behaviour, lookups, relational, runs
from cadence.plans.registry import register, table
from cadence.sources import sinks


@register("enrich_by_id", """
SELECT o.o_orderkey, c.c_custkey, c.c_name, c.c_nationkey, round(c.c_acctbal, 6) AS c_acctbal, c.c_mktsegment
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def q_enrich_by_id(spark, sf_dir):
    """C4: partial order records (id + order key) replaced by the stored customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    c = table(spark, sf_dir, "customer")
    out = lookups.enrich_by_id(o, c, "c_custkey", keep=["o_orderkey"])
    return out.select("o_orderkey", "c_custkey", "c_name", "c_nationkey",
                      F.round("c_acctbal", 6).alias("c_acctbal"), "c_mktsegment")


_RUNS_SQL = """
WITH c AS (
  SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM
                 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg
  FROM events),
r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_id FROM c)
"""


@register("feature_lookup", _RUNS_SQL + """
, f AS (SELECT user_id, run_id, sum(value) AS total_value FROM r GROUP BY 1, 2),
hit AS (SELECT DISTINCT user_id, run_id FROM r WHERE event_type = 'purchase')
SELECT f.user_id, CAST(f.run_id AS BIGINT) AS run_id, round(f.total_value, 6) AS total_value
FROM f JOIN hit USING (user_id, run_id)
""")
def q_feature_lookup(spark, sf_dir):
    """Stored per-run feature records found by member event ids."""
    e = table(spark, sf_dir, "events")
    f = runs.features_by_run(e, [spec("direct", "sum", "value", title="total_value")], ["event_type"],
                             ["ts", "event_id"], "ts", "event_id", partition_by=["user_id"],
                             bucket="day", member_ids=True)
    rec = sinks.feature_group_records(f, ["value"], ["user_id"], member_col="_did",
                                      meta_exclude=("n_elements", "first_id", "last_id", "event_type"))
    req = e.filter(F.col("event_type") == "purchase").select("event_id")
    hit = lookups.lookup_features(req, rec, "event_id", ["value"], mode="all")
    return hit.select(F.col("_meta._g").getItem("user_id").cast("bigint").alias("user_id"),
                      "run_id", F.round("total_value", 6).alias("total_value"))


_CACHE_SQL = """
WITH c AS (SELECT o_custkey, o_orderdate, max(o_totalprice / 2) AS v FROM orders
           WHERE o_orderstatus = 'F' GROUP BY 1, 2)
"""


def _cache(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                                              "o_totalprice")
    cache = o.filter(F.col("o_orderstatus") == "F").select(
        "o_custkey", "o_orderdate", (F.col("o_totalprice") / 2).alias("v"))
    return lookups.split_cached(o, cache, ["o_custkey", "o_orderdate"], "v")


@register("cache_hits", _CACHE_SQL + """
SELECT o.o_orderkey, round(coalesce(c.v, -1.0), 6) AS cached
FROM orders o LEFT JOIN c ON o.o_custkey = c.o_custkey AND o.o_orderdate = c.o_orderdate
""")
def q_cache_hits(spark, sf_dir):
    hits, _ = _cache(spark, sf_dir)
    return hits.select("o_orderkey", F.round("cached", 6).alias("cached"))


@register("cache_misses", _CACHE_SQL + """
SELECT o.o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = o.o_custkey AND c.o_orderdate = o.o_orderdate)
""")
def q_cache_misses(spark, sf_dir):
    _, miss = _cache(spark, sf_dir)
    return miss.select("o_orderkey")


@register("prediction_monitor", """
WITH a AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view'),
j AS (SELECT a.event_id AS act_id, p.event_id AS pred_id, p.ts AS pts, p.value AS predicted,
             a.value AS actual, (p.value - a.value) * (p.value - a.value) AS score
      FROM a JOIN p ON a.user_id = p.user_id
       AND p.ts > a.ts - INTERVAL 2 HOUR AND p.ts < a.ts - INTERVAL 1 HOUR
      WHERE (p.value - a.value) * (p.value - a.value) > 400)
SELECT act_id, arg_max(pred_id, (pts, pred_id)) AS pred_id,
       round(arg_max(predicted, (pts, pred_id)), 6) AS predicted,
       round(arg_max(actual, (pts, pred_id)), 6) AS actual,
       round(arg_max(score, (pts, pred_id)), 6) AS score
FROM j GROUP BY act_id
""")
def q_prediction_monitor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    act = e.filter(F.col("event_type") == "purchase")
    pred = e.filter(F.col("event_type") == "view")
    m = lookups.monitor_predictions(pred, act, ["user_id"], ts="ts", value="value", id_col="event_id")
    return m.select("act_id", "pred_id", *[F.round(c, 6).alias(c) for c in ("predicted", "actual", "score")])


@register("entity_rollup", """
WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue,
                  avg(l_quantity) AS avg_qty FROM lineitem GROUP BY l_orderkey)
SELECT o.o_orderkey, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
       round(l.revenue, 6) AS revenue, round(l.avg_qty, 6) AS avg_qty
FROM orders o LEFT JOIN l ON o.o_orderkey = l.l_orderkey
""")
def q_entity_rollup(spark, sf_dir):
    """Child aggregated first (partial agg), then one FK join to the parent."""
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.avg("l_quantity").alias("avg_qty"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    j = lookups.relate(o, agg, "o_orderkey", "l_orderkey")
    return j.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"),
                    F.round("revenue", 6).alias("revenue"), F.round("avg_qty", 6).alias("avg_qty"))


_USAGE_SQL = """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max(ts) AS last FROM events GROUP BY 1, 2),
l AS (SELECT user_id, max(day) AS ld FROM d GROUP BY 1),
u AS (SELECT d.user_id, max(last) AS last_seen,
             sum(CASE WHEN day = ld THEN n ELSE 0 END) AS daily_usage,
             sum(CASE WHEN date_trunc('week', day) = date_trunc('week', ld) THEN n ELSE 0 END) AS weekly_usage,
             sum(CASE WHEN date_trunc('month', day) = date_trunc('month', ld) THEN n ELSE 0 END) AS monthly_usage
      FROM d JOIN l USING (user_id) GROUP BY d.user_id)
"""


@register("usage_rollup", _USAGE_SQL + """
SELECT user_id, epoch_us(last_seen) AS last_seen, CAST(daily_usage AS BIGINT) AS daily_usage,
       CAST(weekly_usage AS BIGINT) AS weekly_usage, CAST(monthly_usage AS BIGINT) AS monthly_usage FROM u
""")
def q_usage_rollup(spark, sf_dir):
    u = behaviour.usage_rollup(table(spark, sf_dir, "events"), "user_id", "ts")
    return u.select("user_id", epoch_us("last_seen").alias("last_seen"),
                    *[F.col(c).cast("bigint").alias(c) for c in ("daily_usage", "weekly_usage", "monthly_usage")])


@register("quota_check", _USAGE_SQL + """
SELECT u.user_id, (daily_usage <= 5 + c_nationkey AND weekly_usage <= 30 + 2 * c_nationkey
                   AND monthly_usage <= 60 + 3 * c_nationkey) AS allowed
FROM u JOIN customer c ON u.user_id = c.c_custkey
""")
def q_quota_check(spark, sf_dir):
    u = behaviour.usage_rollup(table(spark, sf_dir, "events"), "user_id", "ts")
    c = table(spark, sf_dir, "customer")
    lim = c.select(F.col("c_custkey").alias("user_id"), (5 + F.col("c_nationkey")).alias("daily_limit"),
                   (30 + 2 * F.col("c_nationkey")).alias("weekly_limit"),
                   (60 + 3 * F.col("c_nationkey")).alias("monthly_limit"))
    return lookups.quota_check(u, lim, "user_id").select("user_id", "allowed")


@register("distinct_users", """
SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100
""")
def q_distinct_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return relational.distinct_keys(e, "user_id", (F.col("event_type") == "purchase") & (F.col("value") > 100))


@register("common_keys", """
SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150
INTERSECT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150
""")
def q_common_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.filter((F.col("event_type") == "purchase") & (F.col("value") > 150))
    b = e.filter((F.col("event_type") == "error") & (F.col("value") > 150))
    return relational.common_keys(a, b, "user_id")


@register("normalize_entity", """
SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority,
       arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus
FROM orders GROUP BY o_custkey
""")
def q_normalize_entity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relational.normalize_entity(o, "o_custkey", ["o_orderpriority", "o_orderstatus"],
                                       ["o_orderdate", "o_orderkey"])


@register("top1_per_key", """
SELECT user_id, arg_min(event_id, (-value, event_id)) AS event_id, round(max(value), 6) AS value
FROM events GROUP BY user_id
""")
def q_top1_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = relational.top1(e, ["user_id"], [(-F.col("value")).alias("a"), F.col("event_id")], ["event_id", "value"])
    return t.select("user_id", "event_id", F.round("value", 6).alias("value"))
