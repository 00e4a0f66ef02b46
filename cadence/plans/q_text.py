"""Registered queries: text functions and language operators.

The DuckDB oracles re-derive the same semantics with SQL string/list
functions (word split, padded words, gram windows, pruning, scoring); RE2
caps repetition counts at 1000, so the URL pattern uses ``+`` there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import text as X
from cadence.operators import language as K
from cadence.plans.registry import register, table

# ------------------------------------------------------------------ SQL helpers


def _d_sanitize(e: str) -> str:
    for pat in (r"<.*?>", r"[0-9]", r'[.,:|/"_\[\]()]', "[♫♪%–]", " {2,}", r"^\s+|\s+$"):
        e = f"regexp_replace({e}, '{pat}', '', 'g')"
    return f"lower({e})"


def _d_detect_text(e: str) -> str:
    e = f"regexp_replace({e}, 'https?://[-_.?&~;+=/#0-9A-Za-z]+', ' ', 'g')"
    e = f"regexp_replace({e}, '{X.RE_MAIL}', ' ', 'g')"
    e = f"regexp_replace({e}, ' {{2,}}', ' ', 'g')"
    lat = f"len(regexp_extract_all({e}, '[A-z]'))"
    non = f"len(regexp_extract_all({e}, '[\\x{{0300}}-\\x{{1DFF}}\\x{{1F00}}-\\x{{10FFFF}}]'))"
    return f"(CASE WHEN {lat} * 2 < {non} THEN regexp_replace({e}, '[A-z]', '', 'g') ELSE {e} END)"


def _d_norm(e: str) -> str:
    e = f"regexp_replace({e}, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', ' ', 'g')"
    e = f"regexp_replace({e}, '[{X.LATIN1_EXCLUDED}]', ' ', 'g')"
    e = f"translate({e}, '{X.ROMANIAN_FROM + X.FARSI_YEH}', '{X.ROMANIAN_TO + X.ARABIC_YEH}')"
    e = f"regexp_replace({e}, '[\\x{{2000}}-\\x{{206F}}]', ' ', 'g')"
    e = f"regexp_replace({e}, '[\\x{{1EA0}}-\\x{{1EFF}}]', '{X.LATIN_EXT_ADDITIONAL_REP}', 'g')"
    e = f"regexp_replace({e}, '[\\x{{3040}}-\\x{{309F}}]', '{X.HIRAGANA_REP}', 'g')"
    e = f"regexp_replace({e}, '[\\x{{30A0}}-\\x{{30FF}}]', '{X.KATAKANA_REP}', 'g')"
    e = f"regexp_replace({e}, '[\\x{{3100}}-\\x{{312F}}\\x{{31A0}}-\\x{{31BF}}]', '{X.BOPOMOFO_REP}', 'g')"
    return f"regexp_replace({e}, '[\\x{{AC00}}-\\x{{D7AF}}]', '{X.HANGUL_REP}', 'g')"


def _d_grams(src: str, key: str, text_expr: str, prefix: str) -> str:
    """CTEs producing ``{prefix}grams(key, gram, n, count)`` from ``src``."""
    p = prefix
    return f"""
{p}t AS (SELECT {key} AS k, string_split({_d_norm(text_expr)}, ' ') AS ws FROM {src}),
{p}w AS (SELECT k, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i, len(ws) AS nw FROM {p}t),
{p}p AS (SELECT k, ' ' || w || CASE WHEN i < nw THEN ' ' ELSE '' END AS pw FROM {p}w WHERE length(w) > 0),
{p}pc AS (SELECT k, pw, count(*) AS cnt FROM {p}p GROUP BY ALL),
{p}e AS (SELECT k, pw, cnt, unnest(generate_series(2, length(pw))) AS e FROM {p}pc),
{p}ok AS (SELECT * FROM {p}e WHERE NOT (
    upper(substr(pw, e, 1)) = substr(pw, e, 1) AND lower(substr(pw, e, 1)) != substr(pw, e, 1) AND
    upper(substr(pw, e - 1, 1)) = substr(pw, e - 1, 1) AND lower(substr(pw, e - 1, 1)) != substr(pw, e - 1, 1))),
{p}g AS (SELECT k, cnt, substr(pw, e - m + 1, m) AS gram
         FROM (SELECT *, unnest(generate_series(1, least(3, e))) AS m FROM {p}ok)),
{p}grams AS (SELECT k, gram, length(gram) AS n, sum(cnt) AS count FROM {p}g WHERE gram != ' ' GROUP BY ALL)"""


def _d_profiles() -> str:
    """CTEs: pruned profile probabilities ``probs(gram, lang, p)`` from documents."""
    return _d_grams("documents", "lang", "text", "tr_") + """,
t AS (SELECT k AS lang, n, sum(count) AS total FROM tr_grams GROUP BY ALL),
t1 AS (SELECT lang, total AS t1 FROM t WHERE n = 1),
g2 AS (SELECT g.k AS lang, g.gram, g.n, g.count, greatest(coalesce(t1.t1, 0) // 100000, 2) AS thr
       FROM tr_grams g LEFT JOIN t1 ON g.k = t1.lang),
kept AS (SELECT lang, gram, n, count FROM g2 WHERE count > thr),
rm AS (SELECT lang, n, sum(count) AS rm FROM g2 WHERE count <= thr GROUP BY ALL),
tot2 AS (SELECT t.lang, t.n, t.total - coalesce(rm.rm, 0) AS total FROM t LEFT JOIN rm USING (lang, n)),
roman AS (SELECT lang, sum(CASE WHEN regexp_full_match(gram, '[A-Za-z]') THEN count ELSE 0 END) AS roman
          FROM kept GROUP BY lang),
chk AS (SELECT r.lang, r.roman < coalesce(t.total, 0) // 3 AS drop_roman
        FROM roman r LEFT JOIN (SELECT * FROM tot2 WHERE n = 1) t USING (lang)),
k2 AS (SELECT k.*, coalesce(chk.drop_roman, false) AND regexp_matches(gram, '[A-Za-z]') AS dr
       FROM kept k LEFT JOIN chk USING (lang)),
final AS (SELECT lang, gram, n, count FROM k2 WHERE NOT dr),
rm2 AS (SELECT lang, n, sum(count) AS rm FROM k2 WHERE dr GROUP BY ALL),
tot3 AS (SELECT tot2.lang, tot2.n, tot2.total - coalesce(rm2.rm, 0) AS total FROM tot2 LEFT JOIN rm2 USING (lang, n)),
probs AS (SELECT gram, lang, count / total AS p FROM final JOIN tot3 USING (lang, n))"""


def _d_detect(src: str, key: str, text: str, log_prior: str = "-ln((SELECT nl FROM nl))") -> str:
    """CTEs: ``det(k, lang, n_grams)`` for texts of ``src`` (after _d_profiles)."""
    lw = "ln(0.5 / 10000)"
    return _d_grams(src, key, _d_detect_text(text), "dt_") + f""",
langs AS (SELECT DISTINCT lang FROM probs),
nl AS (SELECT count(*) AS nl FROM langs),
gk AS (SELECT * FROM dt_grams WHERE gram IN (SELECT gram FROM probs)),
tot AS (SELECT k, sum(count) AS n_grams FROM gk GROUP BY k),
contrib AS (SELECT k, lang, sum(count * (ln(0.5 / 10000 + p) - {lw})) AS s FROM gk JOIN probs USING (gram) GROUP BY ALL),
ids AS (SELECT DISTINCT {key} AS k FROM {src}),
sc AS (SELECT ids.k, langs.lang, coalesce(contrib.s, 0) + coalesce(tot.n_grams, 0) * {lw} + {log_prior} AS sc,
              coalesce(tot.n_grams, 0) AS n_grams
       FROM ids CROSS JOIN langs LEFT JOIN contrib ON contrib.k = ids.k AND contrib.lang = langs.lang
       LEFT JOIN tot ON tot.k = ids.k),
mx AS (SELECT k, max(sc) AS m FROM sc GROUP BY k),
pr AS (SELECT sc.k, sc.lang, sc.n_grams, exp(sc.sc - mx.m) / sum(exp(sc.sc - mx.m)) OVER (PARTITION BY sc.k) AS p
       FROM sc JOIN mx USING (k)),
det AS (SELECT k, CASE WHEN max(n_grams) = 0 THEN 'INV' WHEN max(p) > 0.1 THEN arg_max(lang, (p, -ascii(lang)))
                       ELSE 'unknown' END AS lang, CAST(max(n_grams) AS BIGINT) AS n_grams FROM pr GROUP BY k)"""


def _probs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    g, t = K.train_profiles(docs, "text", "lang")
    g2, t2 = K.prune_profiles(g, t)
    return K.profile_probs(g2, t2)


# ------------------------------------------------------------------ scalar text (H)
@register("sanitize_text", f"SELECT doc_id, {_d_sanitize('text')} AS clean FROM documents")
def q_sanitize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.sanitize_text("text").alias("clean"))


@register("char_tokens", f"""
WITH s AS (SELECT doc_id, {_d_sanitize('text')} AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_tokens,
       CAST(length(t) - length(replace(t, ' ', '')) AS BIGINT) AS n_ws FROM s
""")
def q_char_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.char_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("t", lambda c: c == X.WS_TOKEN)).cast("bigint").alias("n_ws"))


@register("strip_url_mail", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, 'https?://[-_.?&~;+=/#0-9A-Za-z]+', ' ', 'g'),
       '{X.RE_MAIL}', ' ', 'g'), ' {{2,}}', ' ', 'g') AS clean FROM pages
""")
def q_strip_url_mail(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.strip_url_mail("html").alias("clean"))


@register("drop_minor_latin", f"SELECT doc_id, {_d_detect_text('text')} AS clean FROM documents")
def q_drop_minor_latin(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.detection_text("text").alias("clean"))


@register("compose_vietnamese", """
SELECT doc_id, nfc_normalize(replace(replace(replace(text, 'a', 'a' || chr(769)), 'o', 'ơ' || chr(803)), 'U', 'U' || chr(777))) AS composed
FROM documents
""")
def q_compose_vietnamese(spark, sf_dir):
    """H15 on texts whose vowels are written as letter and tone mark."""
    t = F.col("text")
    for plain, pair in (("a", "a\u0301"), ("o", "ơ\u0323"), ("U", "U\u0309")):
        t = F.replace(t, F.lit(plain), F.lit(pair))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", X.compose_vietnamese("t").alias("composed"))


@register("normalize_ngram_chars", f"SELECT doc_id, {_d_norm('text')} AS norm FROM documents")
def q_normalize_ngram_chars(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.normalize_ngram_chars("text").alias("norm"))


# ------------------------------------------------------------------ K1-K4
@register("char_ngrams", "WITH " + _d_grams("benchmark", "item_id", "text", "") + """
SELECT k AS item_id, gram, CAST(n AS BIGINT) AS n, CAST(count AS BIGINT) AS count FROM grams
""")
def q_char_ngrams(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    g = K.char_ngrams(b, ["item_id"], "text")
    return g.select("item_id", "gram", F.col("n").cast("bigint").alias("n"), F.col("count").cast("bigint").alias("count"))


@register("lang_profiles", "WITH " + _d_grams("documents", "lang", "text", "tr_") + """
SELECT k AS lang, gram, CAST(n AS BIGINT) AS n, CAST(count AS BIGINT) AS count FROM tr_grams
""")
def q_lang_profiles(spark, sf_dir):
    g, _ = K.train_profiles(table(spark, sf_dir, "documents"), "text", "lang")
    return g.select("lang", "gram", F.col("n").cast("bigint").alias("n"), F.col("count").cast("bigint").alias("count"))


@register("lang_profiles_pruned", "WITH " + _d_profiles() + """
SELECT lang, gram, CAST(n AS BIGINT) AS n, CAST(count AS BIGINT) AS count FROM final
""")
def q_lang_profiles_pruned(spark, sf_dir):
    g, t = K.train_profiles(table(spark, sf_dir, "documents"), "text", "lang")
    g2, _ = K.prune_profiles(g, t)
    return g2.select("lang", "gram", F.col("n").cast("bigint").alias("n"), F.col("count").cast("bigint").alias("count"))


@register("profile_probs", "WITH " + _d_profiles() + """
SELECT gram, lang, round(p, 9) AS p FROM probs
""")
def q_profile_probs(spark, sf_dir):
    return _probs(spark, sf_dir).select("gram", "lang", F.round("p", 9).alias("p"))


# ------------------------------------------------------------------ K5, K7, K8
@register("detect_language", "WITH " + _d_profiles() + "," + _d_detect("documents", "doc_id", "text") + """
SELECT k AS doc_id, lang, n_grams FROM det
""")
def q_detect_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = K.detect_language(docs, "doc_id", "text", _probs(spark, sf_dir))
    return d.select("doc_id", "lang", F.col("n_grams").cast("bigint").alias("n_grams"))


# K6: unequal priors; a language without one cannot win
@register("detect_language_prior", "WITH " + _d_profiles() + "," + _d_detect("documents", "doc_id", "text", """
    CASE langs.lang WHEN 'en' THEN ln(0.5) WHEN 'de' THEN ln(0.25) WHEN 'fr' THEN ln(0.25) ELSE CAST('-inf' AS DOUBLE) END
""") + """
SELECT k AS doc_id, lang, n_grams FROM det
""")
def q_detect_language_prior(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = K.detect_language(docs, "doc_id", "text", _probs(spark, sf_dir), prior={"en": 2.0, "de": 1.0, "fr": 1.0})
    return d.select("doc_id", "lang", F.col("n_grams").cast("bigint").alias("n_grams"))


@register("detect_accuracy", "WITH " + _d_profiles() + "," + _d_detect("documents", "doc_id", "text") + """
SELECT d.lang AS lang, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN det.lang = d.lang THEN 1 ELSE 0 END) AS BIGINT) AS correct
FROM documents d JOIN det ON det.k = d.doc_id GROUP BY d.lang
""")
def q_detect_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = K.detect_language(docs.select("doc_id", "text"), "doc_id", "text", _probs(spark, sf_dir))
    j = docs.select("doc_id", F.col("lang").alias("truth")).join(d, "doc_id")
    return j.groupBy(F.col("truth").alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("lang") == F.col("truth")).cast("bigint")).alias("correct"))


_CONV_SRC = "(SELECT conv_id * 100000 + turn AS cid, text FROM conversations)"


@register("language_stats", "WITH " + _d_profiles() + "," + _d_detect(_CONV_SRC, "cid", "text") + """
SELECT 'text' AS "column", lang, CAST(count(*) AS BIGINT) AS n FROM det GROUP BY lang
""")
def q_language_stats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("cid"), "text")
    s = K.language_stats(c, "cid", ["text"], _probs(spark, sf_dir))
    return s.select("column", "lang", F.col("n").cast("bigint").alias("n"))


_CONV_TWO = """(SELECT conv_id * 1000000 + turn * 10 + 1 AS cid, text FROM conversations UNION ALL
SELECT conv_id * 1000000 + turn * 10 + 2, role || ' ' || role FROM conversations)"""


@register("language_stats_overall", "WITH " + _d_profiles() + "," + _d_detect(_CONV_TWO, "cid", "text") + """,
one AS (SELECT CASE WHEN k % 10 = 1 THEN 'text' ELSE 'roles' END AS "column", lang FROM det)
SELECT "column", lang, CAST(count(*) AS BIGINT) AS n FROM one GROUP BY GROUPING SETS (("column", lang), (lang))
""")
def q_language_stats_overall(spark, sf_dir):
    """K7: languages by column and over both columns, from one detection."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("cid"), "text",
                                                     F.concat_ws(" ", "role", "role").alias("roles"))
    return K.language_stats(c, "cid", ["text", "roles"], _probs(spark, sf_dir), overall=True)


@register("row_languages", "WITH " + _d_profiles() + "," + _d_detect(_CONV_SRC, "cid", "text") + """
SELECT k AS cid, lang AS text_lng FROM det
""")
def q_row_languages(spark, sf_dir):
    """K7: the language of each row beside its text."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("cid"), "text")
    return K.with_languages(c, "cid", ["text"], _probs(spark, sf_dir)).select("cid", F.col("`text.lng`").alias("text_lng"))


@register("language_stats_own_detector", """
SELECT 'text' AS "column", CASE WHEN contains(text, 'é') THEN 'accents' ELSE 'INV' END AS lang, CAST(count(*) AS BIGINT) AS n
FROM documents GROUP BY ALL
""")
def q_language_stats_own_detector(spark, sf_dir):
    """A detector of the user's; rows for which it has no answer count as INV."""
    def detector(d, i, t, probs):
        return d.filter(F.col(t).contains("é")).select(i, F.lit("accents").alias("lang"))
    return K.language_stats(table(spark, sf_dir, "documents"), "doc_id", ["text"], None, detector)


_NAMES_SQL = ", ".join(f"('{k}', '{v}')" for k, v in sorted(K.LANGUAGE_NAMES.items()))


@register("language_names", f"""
WITH names(code, name) AS (VALUES {_NAMES_SQL})
SELECT d.lang, n.name, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN names n ON d.lang = n.code
GROUP BY d.lang, n.name
""")
def q_language_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = F.broadcast(K.language_names(spark))       # fixed small table
    return d.join(names, d.lang == names.code, "left").select("lang", "name", "n")


# ------------------------------------------------------------------ K9-K13
_VOCAB = 100
_VOCAB_SQL = f"""
s AS (SELECT {_d_sanitize('text')} AS t FROM documents),
tok AS (SELECT CASE WHEN c = ' ' THEN '<ws>' ELSE c END AS token
        FROM (SELECT unnest(string_split(t, '')) AS c FROM s WHERE length(t) > 0)),
cnt AS (SELECT token, count(*) AS count FROM tok GROUP BY token),
top AS (SELECT token, row_number() OVER (ORDER BY count DESC, token) + 1 AS id, count FROM cnt
        QUALIFY id <= {_VOCAB - 1}),
vocab AS (SELECT token, CAST(id AS INTEGER) AS id, CAST(count AS BIGINT) AS count FROM top
          UNION ALL SELECT '<unk>', 0, NULL UNION ALL SELECT '<pad>', 1, NULL)"""


@register("char_vocab", f"WITH {_VOCAB_SQL} SELECT token, id, count FROM vocab")
def q_char_vocab(spark, sf_dir):
    v, _ = K.build_vocab(table(spark, sf_dir, "documents"), "text", _VOCAB)
    return v


@register("vocab_stats", f"""
WITH s AS (SELECT {_d_sanitize('text')} AS t FROM documents)
SELECT CAST(max(length(t)) AS INTEGER) AS max_len,
       (SELECT CAST(count(DISTINCT c) AS BIGINT) FROM (SELECT unnest(string_split(t, '')) AS c FROM s)) AS n_tokens
FROM s
""")
def q_vocab_stats(spark, sf_dir):
    _, st = K.build_vocab(table(spark, sf_dir, "documents"), "text", _VOCAB)
    return st.select(F.col("max_len").cast("int").alias("max_len"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@register("text_ids", f"""
WITH {_VOCAB_SQL},
b AS (SELECT item_id, {_d_sanitize('text')} AS t FROM benchmark),
tk AS (SELECT item_id, unnest(string_split(t, '')) AS c, unnest(generate_series(1, length(t))) AS pos
       FROM b WHERE length(t) > 0),
j AS (SELECT tk.item_id, tk.pos, coalesce(v.id, 0) AS id FROM tk
      LEFT JOIN vocab v ON v.token = CASE WHEN tk.c = ' ' THEN '<ws>' ELSE tk.c END ),
m AS (SELECT max(length(t)) AS n FROM b),
agg AS (SELECT b.item_id, coalesce(string_agg(CAST(j.id AS VARCHAR), ',' ORDER BY j.pos), '') AS s,
               count(j.pos) AS n FROM b LEFT JOIN j USING (item_id) GROUP BY b.item_id)
SELECT item_id,
       array_to_string(list_concat(list_concat(
           CAST(list_transform(generate_series(1, ((SELECT m.n FROM m) - agg.n) // 2), lambda x: 1) AS INTEGER[]),
           CASE WHEN agg.n = 0 THEN CAST([] AS INTEGER[]) ELSE CAST(string_split(s, ',') AS INTEGER[]) END),
           CAST(list_transform(generate_series(1, (SELECT m.n FROM m) - agg.n - ((SELECT m.n FROM m) - agg.n) // 2), lambda x: 1) AS INTEGER[])), ',') AS ids
FROM agg
""")
def q_text_ids(spark, sf_dir):
    v, _ = K.build_vocab(table(spark, sf_dir, "documents"), "text", _VOCAB)
    b = table(spark, sf_dir, "benchmark")
    out = K.text_to_ids(b, "text", v)
    return out.select("item_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@register("class_split", """
WITH x AS (SELECT doc_id, quality, CAST('0x' || substr(md5(concat(doc_id, ':3')), 1, 15) AS BIGINT) AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h DESC, doc_id DESC) AS rn FROM x)
SELECT doc_id, quality, CASE WHEN rn <= 50 THEN 'test' ELSE 'train' END AS split FROM r
""")
def q_class_split(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return K.class_split(lab, "quality", "doc_id", test_size=50, seed=3).select("doc_id", "quality", "split")


@register("char_scripts", f"""
WITH {_VOCAB_SQL}
SELECT token, id, CASE WHEN token IN ('<unk>', '<pad>', '<ws>') THEN 'Others' WHEN regexp_full_match(token, '\\p{{Latin}}') THEN 'Latin' WHEN regexp_full_match(token, '\\p{{Greek}}') THEN 'Greek' WHEN regexp_full_match(token, '\\p{{Cyrillic}}') THEN 'Cyrillic' WHEN regexp_full_match(token, '\\p{{Arabic}}') THEN 'Arabic' WHEN regexp_full_match(token, '\\p{{Hebrew}}') THEN 'Hebrew' WHEN regexp_full_match(token, '\\p{{Han}}') THEN 'Han' WHEN regexp_full_match(token, '\\p{{Hiragana}}') THEN 'Hiragana' WHEN regexp_full_match(token, '\\p{{Katakana}}') THEN 'Katakana' WHEN regexp_full_match(token, '\\p{{Hangul}}') THEN 'Hangul' WHEN regexp_full_match(token, '\\p{{Devanagari}}') THEN 'Devanagari' WHEN regexp_full_match(token, '\\p{{Thai}}') THEN 'Thai' WHEN regexp_full_match(token, '\\p{{Armenian}}') THEN 'Armenian' WHEN regexp_full_match(token, '\\p{{Georgian}}') THEN 'Georgian'
                       ELSE 'Others' END AS script FROM vocab
""")
def q_char_scripts(spark, sf_dir):
    """Script of every vocabulary character (oracle: RE2 script classes)."""
    v, _ = K.build_vocab(table(spark, sf_dir, "documents"), "text", _VOCAB)
    return K.char_scripts(v).select("token", "id", "script")
