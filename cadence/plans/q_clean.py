"""Registered queries: sources, cleaning, sinks and scalar functions (A, B, H)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions import scalars as S
from cadence.operators import cleaning as B
from cadence.plans.registry import register, table
from cadence.sources import readers, sinks

# events with null tokens / NaN / Inf injected the same way on both sides
_DIRTY_SQL = """(SELECT event_id, ts, user_id,
    CASE event_type WHEN 'error' THEN 'NULL' WHEN 'view' THEN '' WHEN 'click' THEN NULL
                    WHEN 'signup' THEN 'NA' ELSE event_type END AS tok,
    CASE WHEN value > 300 THEN 'inf'::DOUBLE WHEN value > 290 THEN '-inf'::DOUBLE
         WHEN value < 1 THEN 'nan'::DOUBLE WHEN value < 3 THEN NULL ELSE value END AS x
  FROM events)"""


def dirty_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    et, v = F.col("event_type"), F.col("value")
    tok = (F.when(et == "error", "NULL").when(et == "view", "").when(et == "click", None)
           .when(et == "signup", "NA").otherwise(et))
    x = (F.when(v > 300, math.inf).when(v > 290, -math.inf).when(v < 1, math.nan)
         .when(v < 3, None).otherwise(v))
    return e.select("event_id", "ts", "user_id", tok.alias("tok"), x.alias("x"))


def _r6(c):
    return F.round(c, 6).alias(c)


@register("null_token_filter", f"""
SELECT event_id, tok FROM {_DIRTY_SQL} d WHERE tok IS NOT NULL AND tok NOT IN ('NULL', 'null', '')
""")
def q_null_token_filter(spark, sf_dir):
    return B.drop_null_tokens(dirty_events(spark, sf_dir), ["tok"]).select("event_id", "tok")


@register("time_range", """
SELECT event_id, user_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 06:00:00'
""")
def q_time_range(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return B.time_range(e, "ts", "2024-01-05 00:00:00", "2024-01-12 06:00:00").select("event_id", "user_id")


@register("bounded_read", f"""
SELECT user_id, tok FROM {_DIRTY_SQL} d
WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'
  AND tok IS NOT NULL AND tok NOT IN ('NULL', 'null', '')
ORDER BY CAST('0x' || substr(md5(concat(event_id, ':7')), 1, 15) AS BIGINT), event_id
LIMIT 500
""")
def q_bounded_read(spark, sf_dir):
    """Time range + null-token filter + seeded sample of 500 + id dropped."""
    d = dirty_events(spark, sf_dir)
    out = readers.bounded_read(d, fields=["user_id", "tok"], ts="ts", start="2024-01-03",
                               end="2024-01-20", sample=500, id_col="event_id", seed=7)
    return out.select("user_id", "tok")


@register("sample_rows", """
SELECT o_orderkey, o_orderpriority FROM orders
WHERE o_orderpriority IS NOT NULL AND o_orderpriority NOT IN ('NULL', 'null', '')
ORDER BY CAST('0x' || substr(md5(concat(o_orderkey, ':0')), 1, 15) AS BIGINT), o_orderkey LIMIT 100
""")
def q_sample_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return readers.sample_rows(o, ["o_orderpriority"], n=100, id_col="o_orderkey")


@register("inf_to_null", f"""
SELECT event_id, round(CASE WHEN abs(x) = 'inf'::DOUBLE THEN NULL ELSE x END, 6) AS x FROM {_DIRTY_SQL} d
""")
def q_inf_to_null(spark, sf_dir):
    d = B.inf_to_null(dirty_events(spark, sf_dir).select("event_id", "x"))
    return d.select("event_id", _r6("x"))


@register("dropna_any", f"""
SELECT event_id, tok, round(x, 6) AS x FROM {_DIRTY_SQL} d
WHERE tok IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)
""")
def q_dropna_any(spark, sf_dir):
    d = B.dropna_any(dirty_events(spark, sf_dir).select("event_id", "tok", "x"))
    return d.select("event_id", "tok", _r6("x"))


@register("drop_roles", """
SELECT o_orderstatus, epoch_us(o_orderdate) AS o_orderdate, o_orderpriority FROM orders
""")
def q_drop_roles(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("target_value_o_totalprice", F.col("o_totalprice"))
    out = B.drop_roles(o, ids=["o_orderkey"], keys=["o_custkey"], targets=["o_totalprice"])
    return out.withColumn("o_orderdate", S.epoch_us("o_orderdate"))


@register("cleanup_na", f"""
SELECT event_id,
       CASE WHEN tok IS NULL OR tok IN ('NA', 'None', 'null', 'NULL') THEN '0' ELSE tok END AS tok,
       round(CASE WHEN x IS NULL OR abs(x) = 'inf'::DOUBLE THEN 0 ELSE x END, 6) AS x
FROM {_DIRTY_SQL} d
""")
def q_cleanup_na(spark, sf_dir):
    d = B.cleanup_na(dirty_events(spark, sf_dir).select("event_id", "tok", "x"), ["tok", "x"])
    return d.select("event_id", "tok", _r6("x"))


@register("nan_to_num", f"""
SELECT event_id,
       CASE WHEN x IS NULL OR isnan(x) THEN 0 WHEN x = 'inf'::DOUBLE THEN 1.7976931348623157e308
            WHEN x = '-inf'::DOUBLE THEN -1.7976931348623157e308 ELSE round(x, 6) END AS x
FROM {_DIRTY_SQL} d
""")
def q_nan_to_num(spark, sf_dir):
    d = B.nan_to_num(dirty_events(spark, sf_dir).select("event_id", "x"), ["x"])
    return d.select("event_id", F.when(F.abs("x") > 1e300, F.col("x")).otherwise(F.round("x", 6)).alias("x"))


@register("expand_datetime", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS o_orderdate_year,
       CAST(month(o_orderdate) AS BIGINT) AS o_orderdate_month,
       CAST(day(o_orderdate) AS BIGINT) AS o_orderdate_day,
       CAST(hour(o_orderdate) AS BIGINT) AS o_orderdate_hour,
       CAST(minute(o_orderdate) AS BIGINT) AS o_orderdate_minute
FROM orders
""")
def q_expand_datetime(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    out = B.expand_datetime(o, ["o_orderdate"])
    return out.select("o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


@register("cast_fields", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice,
       o_orderstatus FROM orders
""")
def q_cast_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return B.cast_fields(o, {"o_orderkey": "str", "o_totalprice": "int", "absent": "float"})


@register("impute_mean", """
WITH x AS (SELECT l_orderkey, l_linenumber,
                  CASE WHEN l_quantity < 5 THEN NULL ELSE l_discount END AS d,
                  CASE WHEN l_tax > 0.07 THEN NULL ELSE l_extendedprice END AS p
           FROM lineitem)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(coalesce(d, (SELECT avg(d) FROM x)), 6) AS d,
       round(coalesce(p, (SELECT avg(p) FROM x)), 6) AS p
FROM x
""")
def q_impute_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x = li.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                  F.when(F.col("l_quantity") < 5, None).otherwise(F.col("l_discount")).alias("d"),
                  F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_extendedprice")).alias("p"),
                  F.lit(None).cast("double").alias("all_null"))
    out = B.impute_mean(x, ["d", "p", "all_null"])
    assert "all_null" not in out.columns
    return out.select("l_orderkey", "l_linenumber", _r6("d"), _r6("p"))


@register("tail_rows", """
SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10
""")
def q_tail_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return B.tail_rows(e, 10, ["ts", "event_id"]).select("event_id", "user_id")


_PHONE_CAND = r"\+?[0-9(][0-9() -]{5,}[0-9]"


@register("phone_filter", f"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE_CAND}')) AS cand FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_phones FROM c
WHERE regexp_matches(cand, '{S.PHONE_PATTERN}')
GROUP BY doc_id
""")
def q_phone_filter(spark, sf_dir):
    """B16 applied to phone-like candidates found in whole document texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    c = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PHONE_CAND), 0)).alias("cand"))
    return c.filter(S.is_phone("cand")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_phones"))


@register("l2_normalize", """
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS nrm FROM x GROUP BY vec_id)
SELECT vec_id, round(sum(CASE WHEN pos <= 4 THEN CAST(v AS DOUBLE) / nrm ELSE 0 END), 6) AS head4,
       round(sum(CAST(v AS DOUBLE) * CAST(v AS DOUBLE) / (nrm * nrm)), 6) AS sq_norm
FROM x JOIN n USING (vec_id) GROUP BY vec_id
""")
def q_l2_normalize(spark, sf_dir):
    """Row L2 normalisation (summarised: first-4 sum and squared norm)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = e.withColumn("n", readers.l2_normalize(F.col("embedding")))
    return x.select("vec_id",
                    F.round(F.aggregate(F.slice("n", 1, 4), F.lit(0.0), lambda a, v: a + v), 6).alias("head4"),
                    F.round(F.aggregate("n", F.lit(0.0), lambda a, v: a + v * v), 6).alias("sq_norm"))


@register("upsert_latest", """
WITH base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, 0 AS src FROM orders),
upd AS (SELECT o_orderkey, 'U' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, 1 AS src
        FROM orders WHERE o_orderkey % 7 = 0
        UNION ALL SELECT o_orderkey + 100000000, 'N', 1.0, 1 FROM orders WHERE o_orderkey % 11 = 0),
a AS (SELECT * FROM base UNION ALL SELECT * FROM upd)
SELECT o_orderkey, arg_max(o_orderstatus, src) AS o_orderstatus, round(arg_max(o_totalprice, src), 6) AS o_totalprice
FROM a GROUP BY o_orderkey
""")
def q_upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    upd = o.filter(k % 7 == 0).select("o_orderkey", F.lit("U").alias("o_orderstatus"),
                                      (F.col("o_totalprice") * 2).alias("o_totalprice"))
    new = o.filter(k % 11 == 0).select((k + 100000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"),
                                       F.lit(1.0).alias("o_totalprice"))
    out = sinks.upsert_latest(o, upd.unionByName(new), ["o_orderkey"])
    return out.select("o_orderkey", "o_orderstatus", _r6("o_totalprice"))


@register("feature_group_records", """
SELECT user_id AS g_user, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total
FROM events GROUP BY user_id
""")
def q_feature_group_records(spark, sf_dir):
    """Nested records built per user group (checked through their fields)."""
    e = table(spark, sf_dir, "events")
    f = e.groupBy("user_id").agg(F.min("ts").alias("_ts"), F.count(F.lit(1)).alias("n"),
                                 F.sum("value").alias("total"))
    rec = sinks.feature_group_records(f, ["value"], ["user_id"])
    return rec.select(F.col("_meta._g").getItem("user_id").cast("bigint").alias("g_user"),
                      "n", _r6("total"))


# ---------------------------------------------------------------- scalars (H)
@register("timespan_seconds", """
SELECT event_id,
       round(CAST(user_id % 5 AS DOUBLE) * 3600 + CAST(event_id % 60 AS DOUBLE) * 60 + round(value, 2), 6) AS seconds
FROM events
""")
def q_timespan_seconds(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    span = F.concat_ws(":", (F.col("user_id") % 5).cast("string"), (F.col("event_id") % 60).cast("string"),
                       F.round("value", 2).cast("string"))
    return e.select("event_id", F.round(S.parse_timespan(span), 6).alias("seconds"))


@register("epoch_seconds", """
SELECT o_orderkey, round(epoch_us(o_orderdate) / 1000000.0, 6) AS epoch_s FROM orders
""")
def q_epoch_seconds(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(S.epoch_seconds("o_orderdate"), 6).alias("epoch_s"))


@register("bin_roundtrip", """
SELECT event_id,
       '1' || CASE WHEN length(bin(event_id % 700)) < 8 THEN lpad(bin(event_id % 700), 8, '0')
                   ELSE bin(event_id % 700) END AS code,
       CAST(event_id % 700 AS BIGINT) AS decoded
FROM events
""")
def q_bin_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 700).alias("i"))
    x = e.withColumn("code", S.int_to_code("i"))
    return x.select("event_id", "code", S.code_to_int("code").alias("decoded"))


@register("epoch_ms", """
SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS ts_ms FROM events
""")
def q_epoch_ms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.floor(S.epoch_us("ts") / 1000)
    return e.select("event_id", F.date_format(S.epoch_ms_to_ts(ms), "yyyy-MM-dd HH:mm:ss.SSS").alias("ts_ms"))


@register("epoch_by_digits", """
WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS v FROM events
           UNION ALL SELECT event_id + 1000000, (epoch_us(ts) // 1000) * 10 FROM events
           UNION ALL SELECT event_id + 2000000, (epoch_us(ts) // 1000) // 1000 FROM events),
d AS (SELECT event_id, v, CASE length(CAST(abs(v) AS VARCHAR)) WHEN 13 THEN 1000 WHEN 14 THEN 10000
                            ELSE 100 END AS dv FROM x)
SELECT event_id, (v // dv) * 1000000 + ((v % dv) * 1000000) // dv AS ts_us FROM d
""")
def q_epoch_by_digits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    ms = F.floor(S.epoch_us("ts") / 1000).cast("bigint")
    x = e.select("event_id", ms.alias("v")) \
        .unionByName(e.select((F.col("event_id") + 1000000).alias("event_id"), (ms * 10).alias("v"))) \
        .unionByName(e.select((F.col("event_id") + 2000000).alias("event_id"), F.floor(ms / 1000).cast("bigint").alias("v")))
    return x.select("event_id", S.epoch_us(S.epoch_by_digits("v")).alias("ts_us"))


@register("json_flatten", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events
""")
def q_json_flatten(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    schema = T.StructType([T.StructField("k", T.LongType())])
    return S.flatten_json(e, "props", schema)


@register("file_source_csv", """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
""")
def q_file_source_csv(spark, sf_dir):
    """A14 -> A1: export the events to CSV (shared scratch folder), read them
    back through the file source (schema inference, ±Inf -> null, drop rows
    with nulls)."""
    import uuid

    from cadence.session import scratch_path
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    sinks.export_csv(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    back = readers.read_file(spark, path, fmt="csv")
    return back.select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"),
                       "event_type", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("object_store_json", """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events
""")
def q_object_store_json(spark, sf_dir):
    """A2: the object-store source on a JSON object written to the shared
    folder (the URI scheme is whatever that folder uses: s3a://, hdfs://,
    file:); JSON objects are read whole, then ±Inf -> null and null rows drop."""
    import uuid

    from cadence.session import scratch_path
    uri = scratch_path(spark, f"objects-{uuid.uuid4().hex[:12]}.json")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value") \
        .write.mode("overwrite").json(uri)
    back = readers.read_object_store(spark, uri)
    return back.select(F.col("event_id").cast("bigint").alias("event_id"),
                       F.col("user_id").cast("bigint").alias("user_id"),
                       "event_type", F.round(F.col("value").cast("double"), 6).alias("value"))


@register("raw_append", """
SELECT event_id, event_type, round(value, 6) AS value, 1 AS batch_ids FROM events
""")
def q_raw_append(spark, sf_dir):
    """Raw records appended in two writes (purchases, then the rest) to a
    store partitioned by type; each write assigns ids to records without one.
    Returns every stored record with the number of distinct ids its write
    gave that id (1 = unique within the write)."""
    import uuid

    from cadence.session import scratch_path
    path = scratch_path(spark, f"raw-{uuid.uuid4().hex[:12]}")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for i, part in enumerate((e.filter(F.col("event_type") == "purchase"),
                              e.filter(~(F.col("event_type") == "purchase") | F.col("event_type").isNull()))):
        sinks.append_raw(part.withColumn("batch", F.lit(i)), path, id_col="_id", partition_by=["batch"])
    back = spark.read.parquet(path)
    # ids are unique per write: count rows sharing (batch, _id) with a
    # grouped count joined back (no window over a whole batch)
    dup = back.groupBy("batch", "_id").agg(F.count(F.lit(1)).alias("batch_ids"))
    out = back.join(dup, ["batch", "_id"])
    return out.select("event_id", "event_type", F.round("value", 6).alias("value"),
                      F.col("batch_ids").cast("int").alias("batch_ids"))


@register("collection_read", f"""
SELECT event_id, user_id, tok, round(x, 6) AS x FROM {_DIRTY_SQL} d
WHERE tok IS NOT NULL AND tok NOT IN ('NULL', 'null', '') AND x IS NOT NULL AND NOT isnan(x)
  AND abs(x) != 'inf'::DOUBLE
""")
def q_collection_read(spark, sf_dir):
    """A stored collection (written parquet) read with null-token
    filtering on all fields, id dropped, ±Inf -> null and null rows dropped."""
    import uuid

    from cadence.session import scratch_path
    path = scratch_path(spark, f"coll-{uuid.uuid4().hex[:12]}")
    d = dirty_events(spark, sf_dir).select(F.col("event_id").alias("_id"), "event_id", "user_id", "tok", "x")
    d.write.parquet(path)
    back = readers.read_collection(spark, path)
    return back.select("event_id", "user_id", "tok", F.round("x", 6).alias("x"))


@register("sample_rows_text_id", """
SELECT 'c-' || c_custkey AS id, c_name FROM customer
ORDER BY CAST('0x' || substr(md5(concat('c-' || c_custkey, ':4')), 1, 15) AS BIGINT), 'c-' || c_custkey LIMIT 50
""")
def q_sample_rows_text_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c-"), F.col("c_custkey")).alias("id"), "c_name")
    return readers.sample_rows(c, ["c_name"], n=50, id_col="id", seed=4)
