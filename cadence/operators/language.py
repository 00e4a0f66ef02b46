"""Language profiles, n-gram language detection and character vocabularies.

Scale design
------------
* Texts are split into words and the words are COUNTED before any n-gram is
  generated: grams are produced once per distinct (group, padded word), then
  weighted by the word count. Natural-language word frequencies are Zipfian,
  so this shrinks the exploded gram volume by orders of magnitude and the
  remaining aggregation is partial (map-side).
* Language probabilities are packed into one row per gram with a column per
  (bounded) language, so the joins to words and to documents have multiplicity
  one whatever the number of languages.
* Detection is deterministic: every gram occurrence contributes
  ``ln(alpha/BASE_FREQ + p(gram|lang))`` (the reference samples grams at
  random and perturbs alpha; the expected ranking is the same).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions import text as X
from cadence.plans.sizing import bounded_broadcast
from cadence.session import cut_lineage
from cadence.sources.readers import sample_key

LESS_FREQ_RATIO = 100_000   # fixed value: profile pruning ratio
MINIMUM_FREQ = 2            # fixed value: minimum kept gram count
ROMAN_CHAR = r"^[A-Za-z]$"     # fixed value
ROMAN_SUBSTR = r".*[A-Za-z].*"  # fixed value

PROBS_BROADCAST_BYTES = 100 << 20
WORDS_BROADCAST_BYTES = 64 << 20
WORD_BYTES = 128    # a word of usual length and its place in a hash table
GRAM_BYTES = 64     # a gram of at most three characters and its place in a hash table


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_counts(df: DataFrame, keys: list[str], text: str, detect: bool = False,
                max_chars: int | None = None) -> DataFrame:
    """(keys, padded word, count) after the text pipeline.

    ``detect=True`` applies the detector's cleaning (H13, H14) first; the
    profile trainer sees the raw text. Both then compose Vietnamese letters and
    normalise characters (H15).
    """
    return _padded_words(_word_arrays(df, keys, text, detect, max_chars), keys) \
        .groupBy(*keys, "pw").agg(F.count(F.lit(1)).alias("cnt"))


def _word_arrays(df: DataFrame, keys: list[str], text: str, detect: bool = False, max_chars: int | None = None) -> DataFrame:
    """(keys, words of the whole text as an array ``__ws``) after the text pipeline."""
    t = df.select(*keys, F.col(text).alias("__t"))
    if detect:
        # each step reads the one before it several times
        t = t.select(*keys, X.strip_url_mail("__t", max_chars).alias("__t"))
        t = t.select(*keys, X.drop_minor_latin("__t").alias("__t"))
    return t.select(*keys, X.ngram_words("__t").alias("__ws"))


def _padded_words(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, padded word), a row for each occurrence; padded as ``text.word_paddings`` does."""
    w = arrays.select(*keys, "__ws", (F.size("__ws") - 1).alias("__last"))
    # outer, as Spark would otherwise run the text pipeline again to look for empty arrays
    w = w.select(*keys, "__last", F.posexplode_outer("__ws").alias("__at", "__w"))
    behind = F.when(F.col("__at") < F.col("__last"), " ").otherwise("")
    return w.filter(F.length("__w") > 0).select(*keys, F.concat(F.lit(" "), "__w", behind).alias("pw"))


def char_ngrams(df: DataFrame, keys: list[str], text: str, detect: bool = False,
                max_chars: int | None = None) -> DataFrame:
    """K1: (keys, gram, n, count) over whole texts."""
    wc = word_counts(df, keys, text, detect, max_chars)
    g = wc.select(*keys, "cnt", F.explode(X.padded_grams(F.col("pw"))).alias("gram"))
    return g.groupBy(*keys, "gram").agg(F.sum("cnt").alias("count")) \
        .withColumn("n", F.length("gram"))


def train_profiles(df: DataFrame, text: str, label: str) -> tuple[DataFrame, DataFrame]:
    """K2: language profiles from labelled texts.

    Returns (grams ``(lang, gram, n, count)``, totals ``(lang, n, total)``).
    """
    g = char_ngrams(df.select(F.col(label).alias("lang"), text), ["lang"], text)
    # profiles are small (grams x languages) and read by every pruning branch:
    # write them once to the shared checkpoint folder
    g = cut_lineage(g)
    totals = g.groupBy("lang", "n").agg(F.sum("count").alias("total"))
    return g, totals


def prune_profiles(grams: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """K3: drop grams with count <= max(total_1 // 100000, 2); then, when the
    kept single Roman letters are fewer than a third of the (reduced) 1-gram
    total, drop every gram containing a Roman letter. Totals follow."""
    t1 = totals.filter(F.col("n") == 1).select("lang", F.col("total").alias("t1"))
    g = grams.join(t1, "lang", "left").withColumn(
        "thr", F.greatest(F.floor(F.coalesce(F.col("t1"), F.lit(0)) / LESS_FREQ_RATIO), F.lit(MINIMUM_FREQ)))
    kept = g.filter(F.col("count") > F.col("thr"))
    removed = g.filter(F.col("count") <= F.col("thr")).groupBy("lang", "n").agg(F.sum("count").alias("rm"))
    tot2 = totals.join(removed, ["lang", "n"], "left") \
        .select("lang", "n", (F.col("total") - F.coalesce(F.col("rm"), F.lit(0))).alias("total"))
    roman = kept.groupBy("lang").agg(F.sum(F.when(F.col("gram").rlike(ROMAN_CHAR), F.col("count"))
                                           .otherwise(0)).alias("roman"))
    chk = roman.join(tot2.filter(F.col("n") == 1).select("lang", F.col("total").alias("r1")), "lang", "left") \
        .select("lang", (F.col("roman") < F.floor(F.coalesce(F.col("r1"), F.lit(0)) / 3)).alias("drop_roman"))
    k2 = kept.join(chk, "lang", "left")
    drop = F.coalesce(F.col("drop_roman"), F.lit(False)) & F.col("gram").rlike(ROMAN_SUBSTR)
    final = k2.filter(~drop).select("lang", "gram", "n", "count")
    rm2 = k2.filter(drop).groupBy("lang", "n").agg(F.sum("count").alias("rm"))
    tot3 = tot2.join(rm2, ["lang", "n"], "left") \
        .select("lang", "n", (F.col("total") - F.coalesce(F.col("rm"), F.lit(0))).alias("total"))
    return final, tot3


def profile_probs(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """K4: p(gram | lang) = count / total of grams of that length."""
    return grams.join(totals, ["lang", "n"]).select(
        "gram", "lang", (F.col("count") / F.col("total")).alias("p"))


def normalize_prior(prior: dict[str, float], langs: list[str]) -> dict[str, float]:
    """K6: prior probabilities restricted to known languages, normalised."""
    out = {}
    for lang in langs:
        p = float(prior.get(lang, 0.0))
        if p < 0:
            raise ValueError("Prior probability must be non-negative.")
        out[lang] = p
    s = sum(out.values())
    if s <= 0:
        raise ValueError("At least one prior probability must be non-zero.")
    return {k: v / s for k, v in out.items()}


def _occurrence_sums(words: DataFrame, per_word: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Sums of ``cols`` over the words of each document, ``(id, cols)``.

    The most frequent words (``cnt``), as many as a broadcast holds, make up most
    of the occurrences: these are summed where they are read. Only occurrences
    of the others, of which no word is frequent, are shuffled by word.
    """
    most = WORDS_BROADCAST_BYTES // (WORD_BYTES + 8 * len(cols))
    # words by the size of their count, in steps of an eighth: a bounded table
    step = F.floor(F.log2("cnt") * 8).cast("int")
    sizes = per_word.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pw")).alias("b")).collect()
    held, taken, least = 0, 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held, taken = held + r["n"], taken + r["b"]
        if held > most or taken > WORDS_BROADCAST_BYTES // 2:
            break
        least = r["step"]
    total = lambda x: x.groupBy(id_col).agg(*[F.sum(c).alias(c) for c in cols])
    if least is None:
        return total(words.join(per_word, "pw"))
    known = per_word.select("pw", *cols, (step >= least).alias("__often"))
    often = F.broadcast(known.filter("__often").drop("__often"))
    sums = total(words.join(often, "pw"))
    if least == min(r["step"] for r in sizes):
        return sums
    seldom = known.filter(~F.col("__often")).drop("__often")
    return total(sums.unionByName(words.join(often, "pw", "left_anti").join(seldom, "pw").select(id_col, *cols)))


def detect_language(df: DataFrame, id_col: str, text: str, probs: DataFrame,
                    prior: dict[str, float] | None = None, alpha: float = X.ALPHA,
                    max_chars: int | None = None) -> DataFrame:
    """K5: language of each text -> ``(id, lang, prob, n_grams)``.

    ``lang`` is the most probable language if its probability exceeds 0.1,
    else ``unknown``; texts without any known gram give ``INV``.
    """
    # the profile table is small and read four times: write it once to the
    # shared checkpoint folder (survives executor loss, cuts the lineage)
    probs = cut_lineage(probs.select("gram", "lang", "p"))
    langs = sorted(r["lang"] for r in probs.select("lang").distinct().collect())   # bounded
    if prior:
        pr = normalize_prior(prior, langs)
        logp = {k: (math.log(v) if v > 0 else -math.inf) for k, v in pr.items()}
    else:
        logp = {k: -math.log(len(langs)) for k in langs}
    w = alpha / X.BASE_FREQ
    lw = math.log(w)
    # grams are generated once per DISTINCT padded word (not per document):
    # a word's scores are the sums of its known grams' log terms,
    # and a document's score is the sum of its words' scores
    # a document's words feed the vocabulary and the scoring: write them once
    # to the shared checkpoint folder instead of running the regex pipeline twice
    arrays = cut_lineage(_word_arrays(df, [id_col], text, detect=True, max_chars=max_chars))
    words = _padded_words(arrays, [id_col])
    vocab = cut_lineage(words.groupBy("pw").agg(F.count(F.lit(1)).alias("cnt")))
    wg = vocab.select("pw", "cnt", F.explode(X.padded_grams(F.col("pw"))).alias("gram"))
    # one row per known gram with a term per language (the languages are
    # bounded), so a word and an occurrence of it meet exactly one match
    term = F.log(F.lit(w) + F.col("p")) - F.lit(lw)
    cols = [f"s{i}" for i in range(len(langs))]
    packed = probs.groupBy("gram").agg(*[F.sum(F.when(F.col("lang") == lg, term).otherwise(0.0)).alias(c)
                                         for lg, c in zip(langs, cols)])
    packed = bounded_broadcast(cut_lineage(packed), PROBS_BROADCAST_BYTES // (GRAM_BYTES + 8 * len(langs)))
    per_word = cut_lineage(wg.join(packed, "gram").groupBy("pw", "cnt").agg(
        F.count(F.lit(1)).alias("known"), *[F.sum(c).alias(c) for c in cols]))
    sums = _occurrence_sums(words, per_word, id_col, ["known", *cols]).withColumnRenamed("known", "n_grams")
    base = df.select(id_col).join(sums, id_col, "left")
    n = F.coalesce(F.col("n_grams"), F.lit(0))
    scores = F.array(*[F.coalesce(F.col(c), F.lit(0.0)) + n * F.lit(lw) + F.lit(logp[lg])
                       for lg, c in zip(langs, cols)])
    x = base.select(id_col, "n_grams", scores.alias("sc"))
    mx = F.array_max("sc")
    ex = F.transform("sc", lambda v: F.exp(v - mx))
    z = F.aggregate(ex, F.lit(0.0), lambda a, v: a + v)
    x = x.withColumn("pr", F.transform(ex, lambda v: v / z))
    best = F.array_max("pr")
    names = F.array(*[F.lit(lg) for lg in langs])
    idx = F.array_position("pr", best)
    lang = F.when(n == 0, F.lit("INV")).when(best > X.PROB_THRESHOLD, F.element_at(names, idx.cast("int"))) \
        .otherwise(F.lit("unknown"))
    return x.select(id_col, lang.alias("lang"), F.when(n == 0, F.lit(None)).otherwise(best).alias("prob"),
                    n.alias("n_grams"))


def _stacked_languages(df: DataFrame, id_col: str, cols: list[str], probs: DataFrame, detector=None) -> DataFrame:
    """``(row id, column, lang)`` of every text of ``cols``, in one detection."""
    detector = detector or (lambda d, i, t, p: detect_language(d, i, t, p))
    stacked = df.select(F.col(id_col).alias("__id"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("txt")) for c in cols])).alias("kv")) \
        .select("__id", F.concat_ws("|", F.col("kv.column"), F.col("__id").cast("string")).alias("__rid"),
                F.col("kv.column").alias("column"), F.col("kv.txt").alias("txt"))
    det = detector(stacked.select("__rid", "txt"), "__rid", "txt", probs)
    return stacked.join(det.select("__rid", "lang"), "__rid", "left").select(
        "__id", "column", F.coalesce("lang", F.lit("INV")).alias("lang"))


def language_stats(df: DataFrame, id_col: str, cols: list[str], probs: DataFrame,
                   detector=None, overall: bool = False) -> DataFrame:
    """K7: per text column and language, the number of rows (``column, lang, n``);
    ``overall`` adds those of each language over all columns (null ``column``),
    from the same pass.

    ``detector`` (N6) is any callable ``(df, id_col, text_col, probs) -> (id, lang)``;
    failures/no grams are counted as ``INV``.
    """
    found = _stacked_languages(df, id_col, cols, probs, detector)
    if overall:
        c, lg = F.col("column"), F.col("lang")
        return found.groupingSets([[c, lg], [lg]], c, lg).agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("column", "lang").agg(F.count(F.lit(1)).alias("n"))


def with_languages(df: DataFrame, id_col: str, cols: list[str], probs: DataFrame, detector=None) -> DataFrame:
    """K7: ``df`` with ``<col>.lng`` beside each text column of ``cols`` (ids are unique)."""
    found = _stacked_languages(df, id_col, cols, probs, detector)
    wide = found.groupBy("__id").agg(*[F.max(F.when(F.col("column") == c, F.col("lang"))).alias(f"{c}.lng") for c in cols])
    return df.join(wide, df[id_col] == wide["__id"], "left").drop("__id")


# Language code -> name for the languages profiled here; they go before Java's names.
LANGUAGE_NAMES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish",
                  "bg": "Bulgarian", "mk": "Macedonian", "uk": "Ukrainian", "nl": "Dutch",
                  "it": "Italian", "pt": "Portuguese", "ru": "Russian"}


def language_names(spark, extra: dict[str, str] | None = None) -> DataFrame:
    """K8: code -> name table (broadcast-joinable, below 200 rows): the two-letter codes of
    ISO 639 with the English names that Java gives them, and ``extra``."""
    locale = spark._jvm.java.util.Locale
    m = {c: locale.forLanguageTag(c).getDisplayLanguage(locale.ENGLISH) for c in locale.getISOLanguages()}
    m.update(LANGUAGE_NAMES, **(extra or {}))
    return spark.createDataFrame(sorted(m.items()), "code string, name string")


# ---------------------------------------------------------------- vocabulary
def build_vocab(df: DataFrame, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The ``size - 2`` most common character tokens (count desc,
    token asc) get ids from 2; 0 = ``<unk>``, 1 = ``<pad>``.

    Returns (vocab ``(token, id, count)``, stats ``(n_tokens, max_len)``).
    """
    # sanitised texts hold single spaces only: count words first, then the
    # characters of each distinct word weighted by its count; spaces are
    # counted arithmetically (words - 1 per non-empty text). One scan of the
    # texts yields the distinct words plus one summary row (w = null: texts,
    # spaces, longest text); that small table is written to the shared
    # checkpoint folder so the regex pipeline runs once.
    t = df.select(X.sanitize_text(F.col(text)).alias("t"))
    ws = F.split("t", " ")
    entry = lambda w, sp, ln: F.struct(w.alias("w"), sp.cast("bigint").alias("sp"),
                                       ln.cast("int").alias("len"))
    summary = F.array(entry(F.lit(None).cast("string"),
                            F.when(F.length("t") > 0, F.size(ws) - 1).otherwise(F.lit(0)), F.length("t")))
    per_text = F.when(F.length("t") > 0, F.concat(
        F.transform(ws, lambda w: entry(w, F.lit(0), F.lit(0))), summary)).otherwise(summary)
    words = cut_lineage(t.select(F.explode(per_text).alias("r")).select("r.*")
                        .groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.sum("sp").alias("sp"),
                                          F.max("len").alias("len")))
    chars = words.filter(F.col("w").isNotNull()) \
        .select(F.explode(F.split("w", "")).alias("token"), "c") \
        .filter(F.col("token") != "").groupBy("token").agg(F.sum("c").alias("count"))
    summ = words.filter(F.col("w").isNull())
    spaces = summ.select(F.lit(X.WS_TOKEN).alias("token"), F.col("sp").alias("count"))
    counts = chars.unionByName(spaces.filter(F.col("count") > 0))
    top = counts.orderBy(F.col("count").desc(), F.col("token")).limit(size - 2)    # TakeOrdered
    w = Window.orderBy(F.col("count").desc(), F.col("token"))                         # <= size rows
    top = top.withColumn("id", (F.row_number().over(w) + 1).cast("int"))
    spark = df.sparkSession
    special = spark.createDataFrame([(X.UNK_TOKEN, 0, None), (X.PAD_TOKEN, 1, None)],
                                    "token string, id int, count bigint")
    vocab = special.unionByName(top.select("token", "id", "count"))
    n_tokens = counts.select(F.count(F.lit(1))).scalar()
    stats = summ.agg(F.max("len").alias("max_len")).withColumn("n_tokens", n_tokens)
    return vocab, stats


def text_to_ids(df: DataFrame, text: str, vocab: DataFrame, max_len: int | None = None,
                auto_trim: bool = False, out: str = "ids") -> DataFrame:
    """Token ids with centred padding (left floor, right ceil, pad = 1),
    unknown -> 0; ``max_len`` is the longest text unless the caller sets it,
    and then longer texts are dropped (training mode) or cut (``auto_trim``). The vocabulary (bounded by its size parameter)
    becomes a literal two-level table by code point, so the whole operator is a narrow projection
    and a character costs two array reads, however large the vocabulary."""
    points = {(32 if r["token"] == X.WS_TOKEN else ord(r["token"])): r["id"] for r in vocab.collect()
              if r["token"] == X.WS_TOKEN or len(r["token"]) == 1}
    pages: list[list[int]] = [[] for _ in range((max(points, default=0) >> 8) + 1)]
    for p, i in points.items():
        page = pages[p >> 8] = pages[p >> 8] or [0] * 256
        page[p & 255] = i
    m = F.array(*[F.lit(page) if page else F.array().cast("array<int>") for page in pages])
    point = lambda t: F.when(t == X.WS_TOKEN, 32).otherwise(F.ascii(t))
    toks = X.char_tokens(F.col(text))
    x = df.withColumn("__t", toks)
    if max_len is None:
        max_len = x.agg(F.max(F.size("__t"))).first()[0] or 0
    elif not auto_trim:
        x = x.filter(F.size("__t") <= max_len)
    x = x.withColumn("__t", F.slice("__t", 1, max_len))
    ids = F.transform(F.transform("__t", point), lambda p: F.coalesce(
        F.get(F.get(m, F.shiftright(p, 8)), p.bitwiseAND(F.lit(255))), F.lit(0)))
    gap = F.greatest(F.lit(max_len) - F.size("__t"), F.lit(0))
    left = F.floor(gap / 2).cast("int")
    right = (gap - left).cast("int")
    full = F.concat(F.array_repeat(F.lit(1), left), ids, F.array_repeat(F.lit(1), right))
    return x.withColumn(out, full).drop("__t")


def class_split(df: DataFrame, label: str, id_col: str, test_size: int = 50, seed: int = 0,
                salt: int = 64) -> DataFrame:
    """Per label, the ``test_size`` rows last in a seeded pseudo-random
    order are ``test``; the rest ``train``. Adds ``split``.

    Skew-safe: candidates are the top ``test_size`` of each (label, salt)
    slice (windows over slices, not over a whole hot label); the per-label
    threshold is taken over those few candidates only.
    """
    h = sample_key(id_col, seed)
    x = df.withColumn("__h", h).withColumn("__s", F.pmod(F.col("__h"), F.lit(salt)))
    ws = Window.partitionBy(label, "__s").orderBy(F.col("__h").desc(), F.col(id_col).desc())
    cand = x.select(label, "__s", "__h", id_col).withColumn("__r", F.row_number().over(ws)) \
        .filter(F.col("__r") <= test_size)
    wl = Window.partitionBy(label).orderBy(F.col("__h").desc(), F.col(id_col).desc())
    thr = cand.withColumn("__r2", F.row_number().over(wl)).filter(F.col("__r2") <= test_size) \
        .groupBy(label).agg(F.min(F.struct("__h", id_col)).alias("__thr"))
    j = x.join(thr, label, "left")
    is_test = F.struct("__h", id_col) >= F.col("__thr")
    return j.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("__h", "__s", "__thr")


def char_scripts(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Script of each vocabulary character; special tokens -> Others."""
    special = F.col(token).isin(X.UNK_TOKEN, X.PAD_TOKEN, X.WS_TOKEN)
    return vocab.withColumn("script", F.when(special, F.lit("Others")).otherwise(X.script_of(F.col(token))))
