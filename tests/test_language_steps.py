"""The short ways through the text pipeline give what the plain one gives."""

from pyspark.sql import functions as F

from cadence.functions import text as X
from cadence.operators import language as K

TEXTS = ["plain ascii words", "", " ", None, "two  spaces and one [bracket] `tick` {x}", "Zażółć gęślą", "über straße–ende…", "ștăță ției",
         "fá áb ợ x́", "فارسی ی", "日本 ひらがな カタカナ 한국어 ㄅㄆ", "\U0001d400b \U0001f600 smile", "NASA AND The iPhone XY", "\u0085a\u0085bạ",
         "see http://a.b/c?d and x@y.zz now", "Привет мир ab", "ends with space ", "ΑΒΓ Σας ΣΑΣ", "ÀÉ Àé ßẞ", "don't stop\n\tnow 12 3"]


def _rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")


def _plain_grams(p):
    """1..3-grams of a padded word, as the comment of K1 says."""
    up = lambda c: c.upper() == c and c.lower() != c
    return [g for e in range(2, len(p) + 1) if not (up(p[e - 1]) and up(p[e - 2]))
            for g in (p[e - n:e] for n in range(1, min(3, e) + 1)) if g != " "]


def test_words_are_those_of_the_whole_normalisation(spark):
    plain = F.split(X.normalize_ngram_chars(X.compose_vietnamese("t"), collapse=True), " ")
    for r in _rows(spark).select("t", X.ngram_words("t").alias("a"), plain.alias("b")).collect():
        assert (r["a"] or []) == (r["b"] or []), r["t"]


def test_padded_words_are_those_of_the_array_function(spark):
    arrays = K._word_arrays(_rows(spark), ["id"], "t", detect=True)
    a = sorted(map(tuple, K._padded_words(arrays, ["id"]).collect()))
    assert a == sorted(map(tuple, arrays.select("id", F.explode(X.word_paddings("__ws"))).collect())) and len(a) > 30


def test_grams_skip_the_ends_inside_capitals_only(spark):
    words = [" NASA ", " The ", " iPhone", " XY ", " a", " ÀÉx ", " straße ", " ΣΑΣ ", " \U0001d400b "]
    for r in spark.createDataFrame([(w,) for w in words], "p string").select("p", X.padded_grams("p").alias("g")).collect():
        assert r["g"] == _plain_grams(r["p"]), r["p"]


def test_words_beyond_the_broadcast_give_the_same_languages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat and the dog word{chr(97 + i % 26)} and the", "en") for i in range(30)]
                                 + [(100 + i, f"der hund und die katze wort{chr(97 + i % 26)} und der", "de") for i in range(30)]
                                 + [(200, None, "de"), (201, "12 34", "en")], "id int, t string, lang string")
    probs = K.profile_probs(*K.prune_profiles(*K.train_profiles(docs, "t", "lang")))

    def found(size):
        monkeypatch.setattr(K, "WORDS_BROADCAST_BYTES", size)
        return {r["id"]: (r["lang"], r["n_grams"], r["prob"] and round(r["prob"], 9)) for r in K.detect_language(docs, "id", "t", probs).collect()}

    whole = found(64 << 20)
    assert whole[3][0] == "en" and whole[103][0] == "de" and whole[200] == whole[201] == ("INV", 0, None)
    assert found(4000) == whole and found(0) == whole


def test_frequent_words_are_not_shuffled_by_document(spark):
    words = spark.createDataFrame([(i, w) for i in range(50) for w in (" the ", " a ")], "id int, pw string")
    per_word = spark.createDataFrame([(" the ", 50, 1.0), (" a ", 50, 2.0)], "pw string, cnt bigint, s double")
    sums = K._occurrence_sums(words, per_word, "id", ["s"])
    assert "SortMergeJoin" not in sums._jdf.queryExecution().executedPlan().toString()
    assert {r["s"] for r in sums.collect()} == {3.0}
