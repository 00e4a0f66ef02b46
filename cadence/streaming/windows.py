"""Watermarked streaming operators: monitoring join, usage counters, sessions (M4-M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_monitor(pred: DataFrame, act: DataFrame, key: str, ts: str, value: str, id_col: str,
                   threshold: float = 400.0, watermark: str = "3 hours") -> DataFrame:
    """M4: stream-stream interval join — predictions strictly 1h-2h older than
    each actual, same key, squared error above ``threshold`` (alert pairs).
    Both sides carry watermarks so join state is dropped after the band."""
    p = pred.select(F.col(key).alias("p_key"), F.col(id_col).alias("pred_id"),
                    F.col(ts).cast("timestamp").alias("p_ts"), F.col(value).alias("predicted")) \
        .withWatermark("p_ts", watermark)
    a = act.select(F.col(key).alias("a_key"), F.col(id_col).alias("act_id"),
                   F.col(ts).cast("timestamp").alias("a_ts"), F.col(value).alias("actual")) \
        .withWatermark("a_ts", watermark)
    cond = (F.col("p_key") == F.col("a_key")) & \
        (F.col("p_ts") > F.col("a_ts") - F.expr("INTERVAL 2 HOURS")) & \
        (F.col("p_ts") < F.col("a_ts") - F.expr("INTERVAL 1 HOURS"))
    j = a.join(p, cond, "inner")
    return j.withColumn("score", (F.col("predicted") - F.col("actual")) ** 2) \
        .filter(F.col("score") > F.lit(threshold)) \
        .select("act_id", "pred_id", "a_ts", "p_ts", "predicted", "actual", "score")


def stream_newest_alert(pairs: DataFrame) -> DataFrame:
    """Of each actual's alert pairs the one with the newest prediction.

    A second stateful operator behind the interval join: an actual's pairs are
    held as one running maximum until the watermark has passed it, when no
    prediction before it can come any more (append mode, state is freed).
    """
    hit = F.struct(F.unix_micros("p_ts").alias("p_us"), "pred_id", "predicted", "actual", "score")
    one = pairs.select("act_id", "a_ts", hit.alias("hit"))
    return one.groupBy("act_id", "a_ts").agg(F.max("hit").alias("hit")).select(
        "act_id", "a_ts", F.timestamp_micros("hit.p_us").alias("p_ts"), "hit.pred_id", "hit.predicted", "hit.actual", "hit.score")


def stream_usage(sdf: DataFrame, user: str, ts: str, period: str = "1 day",
                 watermark: str = "1 day") -> DataFrame:
    """M5: per-user event counts in calendar windows (day/week/month length
    windows) with a watermark, plus the last event time in the window."""
    t = F.col(ts).cast("timestamp")
    return sdf.withColumn("__t", t).withWatermark("__t", watermark) \
        .groupBy(F.col(user), F.window("__t", period).alias("w")) \
        .agg(F.count(F.lit(1)).alias("usage"), F.max("__t").alias("last_seen")) \
        .select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "usage", "last_seen")


def stream_sessions(sdf: DataFrame, user: str, ts: str, gap: str = "30 minutes",
                    watermark: str = "1 hour") -> DataFrame:
    """M6: gap-based sessions per user (``session_window``) with a watermark."""
    t = F.col(ts).cast("timestamp")
    return sdf.withColumn("__t", t).withWatermark("__t", watermark) \
        .groupBy(F.col(user), F.session_window("__t", gap).alias("s")) \
        .agg(F.count(F.lit(1)).alias("n_events")) \
        .select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")
