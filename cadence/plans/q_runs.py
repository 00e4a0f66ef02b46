"""Registered queries: runs, feature language, grouping (D, E, N)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions.features import spec
from cadence.functions.scalars import epoch_us
from cadence.operators import runs
from cadence.plans.registry import register, table
from cadence.sources.chunks import ChunkedReader

# events with injected nulls so null semantics are exercised:
# value < 5 -> null, event_type 'error' -> null
_EV_N = """(SELECT event_id, ts, user_id,
                   CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS event_type,
                   CASE WHEN value < 5 THEN NULL ELSE value END AS value
            FROM events)"""


def events_with_nulls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id",
                    F.when(F.col("event_type") == "error", None).otherwise(F.col("event_type")).alias("event_type"),
                    F.when(F.col("value") < 5, None).otherwise(F.col("value")).alias("value"))


FLAGSHIP_SPECS = [
    spec("direct", "sum", "value", title="total_value"),
    spec("direct", "mean", "value", title="mean_value"),
    spec("direct", "count", "value", title="n_values"),
    spec("direct", "hour", "ts", title="avg_hour"),
    spec("direct", "std", "value", title="std_value"),
    spec("direct", "max", "value", title="max_value"),
]


def _round_feats(df, titles):
    return df.select(*[F.round(c, 6).alias(c) if c in titles else F.col(c) for c in df.columns])


@register("run_features", """
WITH e AS (
  SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM
                      lag(event_type) OVER (ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg
  FROM events),
r AS (
  SELECT *, sum(chg) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_id
  FROM e)
SELECT CAST(run_id AS BIGINT) AS run_id,
       arg_min(event_type, ts) AS event_type,
       epoch_us(min(ts)) AS ts_us,
       CAST(count(*) AS BIGINT) AS n_elements,
       arg_min(event_id, ts) AS first_id,
       arg_max(event_id, ts) AS last_id,
       round(sum(coalesce(value, 0)), 6) AS total_value,
       round(avg(coalesce(value, 0)), 6) AS mean_value,
       round(CAST(count(*) AS DOUBLE), 6) AS n_values,
       round(coalesce(avg(hour(ts)), 0), 6) AS avg_hour,
       round(stddev_pop(coalesce(value, 0)), 6) AS std_value,
       round(max(coalesce(value, 0)), 6) AS max_value
FROM r GROUP BY run_id
""")
def q_run_features(spark, sf_dir):
    """Flagship: consecutive runs of event_type in time order -> features."""
    ev = table(spark, sf_dir, "events")
    out = runs.features_by_run(ev, FLAGSHIP_SPECS, keys=["event_type"],
                               order_by=["ts", "event_id"], ts_col="ts", id_col="event_id")
    out = out.withColumn("ts_us", epoch_us("_ts")).drop("_ts")
    return _round_feats(out, [s["title"] for s in FLAGSHIP_SPECS])


@register("run_groups", """
WITH e AS (
  SELECT event_id, user_id, event_type,
         CASE WHEN event_type IS NOT DISTINCT FROM
                   lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg,
         ts
  FROM events)
SELECT event_id, user_id, event_type,
       CAST(sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS run_id
FROM e
""")
def q_run_groups(spark, sf_dir):
    """E1 per user: run number of every event."""
    ev = table(spark, sf_dir, "events")
    r = runs.run_ids(ev, ["event_type"], ["ts", "event_id"], partition_by=["user_id"],
                     bucket="adaptive:day")
    return r.select("event_id", "user_id", "event_type", "run_id")


@register("run_groups_empty_key", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS run_id FROM events
""")
def q_run_groups_empty_key(spark, sf_dir):
    """Empty key -> every row is its own run (run = position)."""
    ev = table(spark, sf_dir, "events")
    return runs.run_ids(ev, [], ["ts", "event_id"]).select("event_id", "run_id")


@register("chunk_ids", """
SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 100) AS BIGINT) AS chunk_id
FROM events
""")
def q_chunk_ids(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return runs.chunk_ids(ev, 100, ["ts", "event_id"]).select("event_id", "chunk_id")


@register("chunked_read", """
WITH n AS (SELECT CAST(ceil(count(*) / 8) AS BIGINT) AS size FROM events),
x AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT CAST(floor(pos / size) AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n, arg_min(event_id, pos) AS first_id,
       arg_max(event_id, pos) AS last_id, CAST(count(value) AS BIGINT) AS n_values
FROM x, n GROUP BY 1
""")
def q_chunked_read(spark, sf_dir):
    """The events in eight chunks in time order, each read by itself."""
    ev = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    r = ChunkedReader(ev, ["ts", "event_id"], -(-ev.count() // 8) or 1)
    seen = [c.agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", order).alias("first_id"),
                  F.max_by("event_id", order).alias("last_id"), F.count("value").alias("n_values"))
            .select(F.lit(i).cast("bigint").alias("chunk"), "*") for i, c in enumerate(r)]
    none = ev.limit(0).select(F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("n"), F.col("event_id").alias("first_id"),
                              F.col("event_id").alias("last_id"), F.lit(0).cast("bigint").alias("n_values"))
    return reduce(DataFrame.unionByName, seen, none)


@register("features_global", """
SELECT round(sum(coalesce(value,0)), 6) AS total_value,
       round(avg(coalesce(value,0)), 6) AS mean_value,
       round(CAST(count(*) AS DOUBLE), 6) AS n_values,
       round(coalesce(avg(hour(ts)),0), 6) AS avg_hour,
       round(stddev_pop(coalesce(value,0)), 6) AS std_value,
       round(max(coalesce(value,0)), 6) AS max_value
FROM events
""")
def q_features_global(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    out = runs.features_global(ev, FLAGSHIP_SPECS)
    return _round_feats(out, [s["title"] for s in FLAGSHIP_SPECS])


# ---- one query per feature function, events grouped by user_id
_AGG_CASES = {
    # name: (spec, oracle expression over view e)
    "sum": (spec("direct", "sum", "value"), "sum(coalesce(value,0))"),
    "std": (spec("direct", "std", "value"), "stddev_pop(coalesce(value,0))"),
    "max": (spec("direct", "max", "value"), "max(coalesce(value,0))"),
    "min": (spec("direct", "min", "value"), "min(coalesce(value,0))"),
    # biased g1 written out: DuckDB's skewness is bias-corrected
    "skew": (spec("direct", "skew", "value"),
             "coalesce(CASE WHEN var_pop(coalesce(value,0)) > 0 THEN "
             "avg(power(coalesce(value,0) - m, 3)) / power(var_pop(coalesce(value,0)), 1.5) END, 0)"),
    "mean": (spec("direct", "mean", "value"), "avg(coalesce(value,0))"),
    "mode": (spec("direct", "mode", "value"), None),
    "count": (spec("direct", "count", "value"), "CAST(count(*) AS DOUBLE)"),
    "day": (spec("direct", "day", "ts"), "coalesce(avg(day(ts)),0)"),
    "year": (spec("direct", "year", "ts"), "coalesce(avg(year(ts)),0)"),
    "month": (spec("direct", "month", "ts"), "coalesce(avg(month(ts)),0)"),
    "weekday": (spec("direct", "weekday", "ts"), "coalesce(avg(isodow(ts) - 1),0)"),
    "hour": (spec("direct", "hour", "ts"), "coalesce(avg(hour(ts)),0)"),
    "second": (spec("direct", "second", "ts"), "coalesce(avg(second(ts)),0)"),
    "field": (spec("direct", "field", "value"), "coalesce(avg(value),0)"),
    "log": (spec("direct", "log", "value"),
            "avg(CASE WHEN coalesce(value,0) = 0 THEN 0 WHEN coalesce(value,0) < 0 THEN 'NaN'::DOUBLE "
            "ELSE ln(coalesce(value,0)) END)"),
    "isnot": (spec("direct", "isnot", "value"),
              "coalesce(avg(CASE WHEN value IS NULL THEN NULL WHEN value = 0 THEN 1.0 ELSE 0.0 END),0)"),
    "first": (spec("direct", "field", "value", index="first"), "arg_min_null(value, ts)"),
    "last": (spec("direct", "field", "value", index="last"), "arg_max_null(value, ts)"),
    "num_unique": (spec("predicate", "num_unique", spec("direct", "field", "event_type")),
                   "CAST(CASE WHEN count(DISTINCT event_type) = 0 THEN 1 ELSE count(DISTINCT event_type) END AS DOUBLE)"),
    "in": (spec("predicate", "in", spec("direct", "field", "event_type", index="first"),
                in_values=["click", "view"]),
           "CASE WHEN arg_min_null(event_type, ts) IN ('click','view') THEN 1.0 ELSE 0.0 END"),
    "binary_gt": (spec("binary", left=spec("direct", "sum", "value"), op=">", right=500),
                  "CASE WHEN sum(coalesce(value,0)) > 500 THEN 1.0 ELSE 0.0 END"),
    "binary_eq": (spec("binary", left=spec("direct", "count", "value"), op="=", right=60),
                  "CASE WHEN count(*) = 60 THEN 1.0 ELSE 0.0 END"),
    "binary_ne": (spec("binary", left=spec("direct", "month", "ts", index="first"), op="!=", right=1),
                  "CASE WHEN month(arg_min(ts, ts)) != 1 THEN 1.0 ELSE 0.0 END"),
    "nested": (spec("direct", "month", spec("direct", "field", "ts", index="last")),
               "CAST(month(max(ts)) AS DOUBLE)"),
    "nested_scalar": (spec("direct", "mean", spec("direct", "sum", "value")),
                      "sum(coalesce(value,0))"),
}

_MODE_SQL = """
WITH e AS {ev},
c AS (SELECT user_id, coalesce(value, 0) AS v, count(*) AS n FROM e GROUP BY 1, 2),
r AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, v) AS rn FROM c)
SELECT user_id, round(v, 6) AS feature FROM r WHERE rn = 1
"""


def _agg_sql(expr: str) -> str:
    return f"""
WITH e AS {_EV_N},
m AS (SELECT user_id, avg(coalesce(value,0)) AS m FROM e GROUP BY user_id)
SELECT e.user_id, round(CAST({expr} AS DOUBLE), 6) AS feature
FROM e JOIN m USING (user_id) GROUP BY e.user_id
"""


def _make_agg_query(fspec):
    def q(spark, sf_dir):
        ev = events_with_nulls(spark, sf_dir)
        s = dict(fspec, title="feature")
        out = runs.features_by_key(ev, [s], ["user_id"], order_by=["ts", "event_id"])
        return out.select("user_id", F.round("feature", 6).alias("feature"))
    return q


for _name, (_spec, _expr) in _AGG_CASES.items():
    _sql = _MODE_SQL.format(ev=_EV_N) if _name == "mode" else _agg_sql(_expr)
    register(f"agg_{_name}", _sql)(_make_agg_query(_spec))


@register("fold_mean", """
WITH x AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT CAST(pos % 8 AS BIGINT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean
FROM x WHERE NOT isnan(v) GROUP BY 1
""")
def q_fold_mean(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    out = runs.fold_mean(emb, "embedding", 8)
    return out.select(F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


@register("avg_features", """
SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount FROM lineitem
""")
def q_avg_features(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = runs.avg_features(li, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("proportion", """
SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS share
FROM events GROUP BY user_id
""")
def q_proportion(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy("user_id").agg(F.round(runs.proportion("event_type", "purchase"), 6).alias("share"))


@register("group_collect", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, CAST(count(*) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS n_events FROM d GROUP BY 1
""")
def q_group_collect(spark, sf_dir):
    """D29 on pre-aggregated items (one per user-day); list summarised for the oracle."""
    ev = table(spark, sf_dir, "events")
    d = ev.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    g = runs.group_collect(d.withColumn("item", F.struct("day", "n")), "user_id", "item")
    return g.select("user_id", F.col("count").cast("bigint").alias("count"),
                    F.aggregate("items", F.lit(0).cast("bigint"),
                                lambda acc, it: acc + it["n"]).alias("n_events"))


def _value_range(run):
    """A user feature function (N1/N3): value range and first event type of a run."""
    import numpy as np
    v = np.nan_to_num(run["value"], nan=0.0, posinf=np.inf, neginf=-np.inf)
    return {"user_id": int(run["user_id"][0]), "run_id": int(run["run_id"][0]), "value_range": float(v.max() - v.min()),
            "first_type": run["event_type"][0]}


@register("custom_run_features", """
WITH c AS (
  SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM
                 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS chg
  FROM events),
r AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, round(max(coalesce(value, 0)) - min(coalesce(value, 0)), 6) AS value_range,
       arg_min(event_type, (ts, event_id)) AS first_type
FROM r GROUP BY user_id, run_id
""")
def q_custom_run_features(spark, sf_dir):
    """A user's Python function over each run's ordered rows
    (``mapInPandas``, Arrow batches) — the only Python-worker path here."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    out = runs.custom_run_features(ev, _value_range,
                                   "user_id long, run_id long, value_range double, first_type string",
                                   keys=["event_type"], order_by=["ts", "event_id"],
                                   partition_by=["user_id"], bucket="adaptive:day", arrays=True)
    return out.select("user_id", "run_id", F.round("value_range", 6).alias("value_range"), "first_type")


# every fifth user and every eleventh time are null: all rows must be accounted for
_EV_GAPS = """(SELECT event_id, value, event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
                      CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS ts FROM events)"""


def events_with_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "value", "event_type", F.expr("CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END").alias("user_id"),
                    F.expr("CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END").alias("ts"))


@register("run_features_nulls", f"""
WITH c AS (
  SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS chg
  FROM {_EV_GAPS} WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)),
r AS (
  SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run_id FROM c)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, event_type, CAST(count(*) AS BIGINT) AS n_elements,
       round(sum(coalesce(value, 0)), 6) AS total_value
FROM r GROUP BY user_id, run_id, event_type
""")
def q_run_features_nulls(spark, sf_dir):
    out = runs.features_by_run(events_with_gaps(spark, sf_dir), [spec("direct", "sum", "value", title="total_value")],
                               keys=["event_type"], order_by=["ts", "event_id"], ts_col="ts", id_col="event_id",
                               partition_by=["user_id"], bucket="adaptive:day")
    return out.select("user_id", "run_id", "event_type", "n_elements", F.round("total_value", 6).alias("total_value"))
