"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import (alignment, encoding, fingerprints, language_id, licenses, mixing, near_dedup, prefix_trie, quality,
                         suffix_dedup, token_counts, vector_search, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(p.h, CAST(1 + 10 * (i // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31 AS INT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f ON p.h = f.h
""")
def op1(spark, sf_dir):
    path = warc.write_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, path, digest=True).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_fingerprints")
def op2(spark, sf_dir):
    return fingerprints.version_fingerprints(table(spark, sf_dir, "documents"))


@register("op3_near_dedup")
def op3(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80).drop("text_hash")


@register("op5_suffix_dedup")
def op5(spark, sf_dir):
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"), threshold=50)


@register("op4_token_counts")
def op4(spark, sf_dir):
    t = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return t.withColumn("over_limit", F.col("n_tokens") > 512)


@register("op6_licenses", licenses.oracle_sql())
def op6(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@register("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, ~language_id.held_out())
    found = docs.select("doc_id", language_id.held_out().alias("held_out"), language_id.identify(model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@register("op8_byte_bpe")
def op8(spark, sf_dir):
    return encoding.encode(table(spark, sf_dir, "documents"), with_ids=False)


@register("op9_mix", """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 3.0 AS cap,
         list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)) AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, cap / w AS ratio,
    ((SELECT CAST(sum(source_size) AS DOUBLE) FROM s) * 1.0 - (sum(cap) OVER o - cap))
      / ((SELECT sum(w) FROM s) - (sum(w) OVER o - w)) AS level
  FROM s WINDOW o AS (ORDER BY cap / w, coalesce('=' || source, '') ROWS UNBOUNDED PRECEDING)),
c AS (SELECT min(level) FILTER (WHERE level <= ratio) AS common FROM
  (SELECT *, row_number() OVER (ORDER BY ratio, coalesce('=' || source, '')) AS k FROM l)
  WHERE k = (SELECT min(k) FROM (SELECT level, ratio, row_number() OVER (ORDER BY ratio, coalesce('=' || source, '')) AS k FROM l)
             WHERE level <= ratio)),
t AS (SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * w) END AS target,
        (CAST('0x' || substr(md5(coalesce('s:' || source, 'null')), 1, 5) AS BIGINT) + 0.5::DOUBLE) / 1048576 AS u
      FROM l, c),
n AS (SELECT doc_id, size, source_size, target, u,
        CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
        row_number() OVER (PARTITION BY d.source ORDER BY length(CAST(size AS VARCHAR)), substr(CAST(size AS VARCHAR), 1, 1),
          coalesce(((doc_id % 256) + 256) % 256, 0), size, doc_id ASC NULLS LAST) AS i
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(least(floor(u + each * i) - floor(u + each * (i - 1)), 3) AS BIGINT) * size AS taken
FROM n
""")
def op9(spark, sf_dir):
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op10_top_k", """
WITH v AS (
  SELECT vec_id, len(embedding) AS w, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, q.w + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.w = c.w
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op10(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op11_align")
def op11(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))


@register("op12_prefix_trie", """
WITH t AS (
  SELECT conv_id, turn, length(coalesce(text, '')) AS n,
    substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'k': k, 'n': n} ORDER BY turn ASC NULLS FIRST, k) AS path FROM t GROUP BY conv_id),
crc AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS state
  FROM own),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.path, [])[1:xor(c.state, 4294967295) % 6], c.path[xor(c.state, 4294967295) % 6 + 1:]) AS path
  FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (
  SELECT conv_id, len(path) AS size, d, CASE WHEN d > 0 THEN path[d].n ELSE 0 END AS n,
    array_to_string(list_transform(path[1:d], lambda s: s.k), '') AS key
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM built)),
nodes AS (
  SELECT key, CAST(d AS BIGINT) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM steps GROUP BY key, d),
kids AS (SELECT substr(key, 1, length(key) - 32) AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (
  SELECT substr(n.key, 1, CAST(32 * a AS BIGINT)) AS key, sum(CASE WHEN k.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM nodes) n LEFT JOIN kids k ON k.key = n.key GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(k.n_children, 0) AS BIGINT) AS n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up u ON u.key = n.key LEFT JOIN kids k ON k.key = n.key
LEFT JOIN nodes p ON n.depth > 0 AND p.key = substr(n.key, 1, length(n.key) - 32)
""")
def op12(spark, sf_dir):
    paths = prefix_trie.conversation_paths(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(paths))


@register("op13_quality")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out())
    found = quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
