"""Registered queries: behaviour statistics (O1-O5, M6 batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions.scalars import epoch_us
from cadence.operators import behaviour as O
from cadence.plans.registry import register, table

_ORDER = ["ts", "event_id"]

_DUR_SQL = """
WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type,
                  coalesce((epoch_us(lead(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))
                            - epoch_us(ts)) / 1e6, 0) AS d
           FROM events)
"""


@register("label_time", _DUR_SQL + """
SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, round(sum(d), 6) AS seconds FROM s GROUP BY 1, 2, 3
""")
def q_label_time(spark, sf_dir):
    t = O.label_time(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")
    return t.select("user_id", F.col("day").cast("string").alias("day"), "event_type",
                    F.round("seconds", 6).alias("seconds"))


@register("user_daily_sessions", _DUR_SQL + """
, d AS (SELECT user_id, day, count(*) AS n, sum(d) AS sec FROM s GROUP BY 1, 2)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_days, CAST(sum(n) AS BIGINT) AS n_sessions,
       round(sum(sec), 6) AS seconds FROM d GROUP BY 1
""")
def q_user_daily_sessions(spark, sf_dir):
    u = O.user_days(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")
    return u.select("user_id", F.col("n_days").cast("bigint").alias("n_days"),
                    F.aggregate("days", F.lit(0).cast("bigint"), lambda a, x: a + x["n_sessions"]).alias("n_sessions"),
                    F.round(F.aggregate("days", F.lit(0.0), lambda a, x: a + x["seconds"]), 6).alias("seconds"))


_TRANS_SQL = """
WITH x AS (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p1,
                  lag(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p2
           FROM events)
"""


@register("transition_probs", _TRANS_SQL + """
, t AS (SELECT p1 AS parent, event_type AS state, count(*) AS n FROM x WHERE p1 IS NOT NULL GROUP BY 1, 2)
SELECT parent, state, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY parent), 6) AS prob FROM t
""")
def q_transition_probs(spark, sf_dir):
    t = O.transition_probs(table(spark, sf_dir, "events"), "user_id", "event_type", _ORDER, depth=1)
    return t.select("parent", "state", F.col("n").cast("bigint").alias("n"), F.round("prob", 6).alias("prob"))


@register("transition_probs_depth2", _TRANS_SQL + """
, t AS (SELECT p2 || '>' || p1 AS parent, event_type AS state, count(*) AS n FROM x
        WHERE p2 IS NOT NULL GROUP BY 1, 2)
SELECT parent, state, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY parent), 6) AS prob FROM t
""")
def q_transition_probs_depth2(spark, sf_dir):
    t = O.transition_probs(table(spark, sf_dir, "events"), "user_id", "event_type", _ORDER, depth=2)
    return t.select("parent", "state", F.col("n").cast("bigint").alias("n"), F.round("prob", 6).alias("prob"))


_GOAL_SQL = """
WITH x AS (SELECT event_type,
                  coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (
                      PARTITION BY user_id ORDER BY ts, event_id
                      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later
           FROM events),
g AS (SELECT event_type, count(*) AS visits, sum(later) AS reached FROM x GROUP BY 1)
"""


@register("goal_probs", _GOAL_SQL + """
SELECT event_type, CAST(visits AS BIGINT) AS visits, CAST(reached AS BIGINT) AS reached,
       round(reached / visits, 6) AS prob FROM g
""")
def q_goal_probs(spark, sf_dir):
    g = O.goal_probs(table(spark, sf_dir, "events"), "user_id", "event_type", _ORDER, "purchase")
    return g.select("event_type", F.col("visits").cast("bigint").alias("visits"),
                    F.col("reached").cast("bigint").alias("reached"), F.round("prob", 6).alias("prob"))


@register("best_next", _GOAL_SQL + """
, n AS (SELECT DISTINCT event_type AS state,
               lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS action FROM events),
j AS (SELECT state, action, reached / visits AS utility FROM n JOIN g ON n.action = g.event_type
      WHERE action IS NOT NULL)
SELECT state, arg_min(action, (-utility, action)) AS action, round(max(utility), 6) AS utility
FROM j GROUP BY state
""")
def q_best_next(spark, sf_dir):
    b = O.best_next(table(spark, sf_dir, "events"), "user_id", "event_type", _ORDER, "purchase")
    return b.select("state", "action", F.round("utility", 6).alias("utility"))


@register("sessions", """
WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                    <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
                                         AND CURRENT ROW) AS sid FROM x)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us,
       CAST(count(*) AS BIGINT) AS n_events FROM y GROUP BY user_id, sid
""")
def q_sessions(spark, sf_dir):
    """Gap sessions (30 min) per user — the batch twin of streaming M6."""
    s = O.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    return s.select("user_id", epoch_us("start").alias("start_us"), epoch_us("end").alias("end_us"),
                    F.col("n_events").cast("bigint").alias("n_events"))
