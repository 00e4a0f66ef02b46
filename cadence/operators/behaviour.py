"""User-behaviour statistics (O1-O5) and usage counters (M5 batch form).

Ordered per-user logic uses the bucketed helpers of ``runs`` (lag/lead and
"any later row" stitched across day buckets), so a very active user is
spread over many tasks instead of one window partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import epoch_us
from cadence.operators.runs import preceding, shifted, suffix_any


def session_durations(df: DataFrame, user: str, ts: str, id_col: str,
                      bucket="adaptive:hour") -> DataFrame:
    """Each event is a session lasting until the user's next event the same
    day (the day's last event lasts 0 s). Adds ``day`` and ``duration_s``.

    The next event comes from the bucketed ``shifted`` operator, so a hot
    user-day is spread over (hour, slice) buckets instead of one window task.
    """
    x = df.withColumn("day", F.to_date(ts))
    x = shifted(x, epoch_us(ts), [ts, id_col], partition_by=[user, "day"], bucket=bucket,
                direction="lead", out="__nxt")
    return x.withColumn("duration_s", F.coalesce((F.col("__nxt") - epoch_us(ts)) / 1e6, F.lit(0.0))) \
        .drop("__nxt")


def label_time(df: DataFrame, user: str, ts: str, label: str, id_col: str,
               bucket="adaptive:hour") -> DataFrame:
    """O2: seconds spent per label (domain) per user-day."""
    s = session_durations(df, user, ts, id_col, bucket)
    return s.groupBy(user, "day", label).agg(F.sum("duration_s").alias("seconds"))


def user_days(df: DataFrame, user: str, ts: str, label: str, id_col: str,
              bucket="adaptive:hour") -> DataFrame:
    """O1: per user the number of active days and the list of daily session
    summaries ``(day, n_sessions, seconds)``. The list has one entry per day
    (bounded by the calendar, not by the user's event count)."""
    s = session_durations(df, user, ts, id_col, bucket)
    d = s.groupBy(user, "day").agg(F.count(F.lit(1)).alias("n_sessions"),
                                   F.sum("duration_s").alias("seconds"))
    return d.groupBy(user).agg(F.count(F.lit(1)).alias("n_days"),
                               F.array_sort(F.collect_list(F.struct("day", "n_sessions", "seconds"))).alias("days"))


def transition_probs(df: DataFrame, user: str, state: str, order_by: list[str],
                     depth: int = 1, bucket: str = "adaptive:day") -> DataFrame:
    """O3: P(node | parent) = visits(parent -> node) / visits(parent with a successor).

    A node is the path of the last ``depth + 1`` states; its parent the path
    of the ``depth`` states before. Output ``(parent, state, n, prob)``.
    """
    x = preceding(df, state, depth, order_by, partition_by=[user], bucket=bucket, out="__path")
    x = x.filter((F.size("__path") == depth) & F.col("__path")[0]["v"].isNotNull())
    parent = F.concat_ws(">", F.transform("__path", lambda p: p["v"].cast("string")))
    t = x.groupBy(parent.alias("parent"), F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    tot = t.groupBy("parent").agg(F.sum("n").alias("__tot"))
    return t.join(tot, "parent").select("parent", "state", "n", (F.col("n") / F.col("__tot")).alias("prob"))


def goal_probs(df: DataFrame, user: str, state: str, order_by: list[str], goal: str,
               bucket: str = "adaptive:day") -> DataFrame:
    """For each state, the share of its visits after which the user reaches
    ``goal`` later on. Output ``(state, visits, reached, prob)``."""
    x = suffix_any(df, F.col(state) == F.lit(goal), order_by, partition_by=[user], bucket=bucket,
                   out="__later")
    return x.groupBy(state).agg(F.count(F.lit(1)).alias("visits"),
                                F.sum(F.col("__later").cast("int")).alias("reached")) \
        .withColumn("prob", F.col("reached") / F.col("visits"))


def best_next(df: DataFrame, user: str, state: str, order_by: list[str], goal: str,
              bucket: str = "adaptive:day") -> DataFrame:
    """Per state, the observed next action with the highest goal
    probability (utility); ties by action name."""
    gp = goal_probs(df, user, state, order_by, goal, bucket) \
        .select(F.col(state).alias("action"), F.col("prob").alias("utility"))
    nxt = shifted(df, state, order_by, partition_by=[user], bucket=bucket, direction="lead", out="action")
    pairs = nxt.filter(F.col("action").isNotNull()).select(F.col(state).alias("state"), "action").distinct()
    j = pairs.join(gp, "action")
    pick = F.min_by(F.struct("action", "utility"), F.struct((-F.col("utility")).alias("u"), F.col("action")))
    return j.groupBy("state").agg(pick.alias("b")).select("state", "b.action", "b.utility")


def usage_rollup(df: DataFrame, user: str, ts: str) -> DataFrame:
    """M5 (batch): per user the last-seen time and the event counts of the
    last-seen day, ISO week and month (real calendar buckets)."""
    d = df.groupBy(user, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"),
                                                        F.max(ts).alias("last"))
    w = Window.partitionBy(user)                      # one row per user-day
    d = d.withColumn("__ld", F.max("day").over(w))
    wk = lambda c: F.date_trunc("week", c)            # noqa: E731
    mo = lambda c: F.date_trunc("month", c)           # noqa: E731
    return d.groupBy(user).agg(
        F.max("last").alias("last_seen"),
        F.sum(F.when(F.col("day") == F.col("__ld"), F.col("n")).otherwise(0)).alias("daily_usage"),
        F.sum(F.when(wk("day") == wk("__ld"), F.col("n")).otherwise(0)).alias("weekly_usage"),
        F.sum(F.when(mo("day") == mo("__ld"), F.col("n")).otherwise(0)).alias("monthly_usage"))


def sessions(df: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Gap-based sessions per user (batch twin of the streaming M6)."""
    return df.groupBy(user, F.session_window(ts, gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n_events")).select(
        user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events")
