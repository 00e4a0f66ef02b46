"""Vector search, fingerprints, language ID and licence scans against brute force."""

import hashlib
import random
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadence.llm import fingerprints, language_id, licenses, vector_search

ODD = "doc_id long, text string, lang string, source string, n_chars long, bucket string, guest int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", None if t is None else len(t), "b", 1) for i, t, g in rows], ODD)


def brute_top(vectors, k):
    out = []
    rows = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [4, 64])
def test_top_k_against_brute_force(spark, pivots):
    R = random.Random(4)
    hot = [0.25] * 8
    vectors = [(i, hot if i % 3 == 0 else [R.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    vectors += [(400, None), (450, [0.1, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, hot),
                (600, [0.5, 0.25]), (601, [0.5, -1.0]), (602, []), (650, []), (50, vectors[50][1]), (7, vectors[7][1]),
                (700, [3e5] * 8), (701, [-2e5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in vectors], "vec_id long, embedding array<double>, label int, far double, entry int")
    got = vector_search.top_k(df, F.col("vec_id") % 50 == 0, k=5, pivots=pivots, page=32)
    assert sorted(map(tuple, got.collect())) == brute_top(vectors, 5)


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_search.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert vector_search.top_k(one, F.col("vec_id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], schema)
    assert [tuple(r) for r in vector_search.top_k(two, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]


def broadcasts(node):
    """Types of the columns of each broadcast in a plan that ran."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return broadcasts(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return broadcasts(node.plan())
    found = [node.schema().simpleString()] if kind == "BroadcastExchangeExec" else []
    below = node.children()
    return found + [x for i in range(below.size()) for x in broadcasts(below.apply(i))]


def test_top_k_broadcasts_no_vectors(spark):
    R = np.random.default_rng(3)
    vectors = [(i, v) for i, v in enumerate(R.normal(0, 0.2, (2000, 16)).tolist())]
    got = vector_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0, k=3, page=64)
    got.collect()
    found = broadcasts(got._jdf.queryExecution().executedPlan())
    assert found and not [x for x in found if "binary" in x]


@pytest.mark.parametrize("most", [1, 4000])
def test_top_k_in_groups_of_pages(spark, monkeypatch, most):
    monkeypatch.setattr(vector_search, "GROUP_BYTES", most)
    R = random.Random(14)
    hot = [0.5] * 6
    vectors = [(i - 300, hot if i % 4 == 0 else [R.gauss(0, 10 ** R.choice([-1, 0, 2, 4])) for _ in range(6)]) for i in range(600)]
    vectors += [(i, [R.uniform(-1, 1) * 10 ** R.choice([0, 5, 6]) for _ in range(3)]) for i in range(640, 760)]
    vectors += [(i, [R.choice([0.0, 1.0])]) for i in range(800, 880)] + vectors[:40]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vector_search.top_k(df, F.col("vec_id") % 50 == 0, k=4, pivots=8, page=16).collect()))
    assert got == brute_top(vectors, 4)


def piece_set(text):
    raw = text.encode()
    return set(fingerprints.pieces(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1].tolist())


def test_fingerprints_against_brute_force(spark):
    R = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "é", "zeta", "eta"]
    texts = [(i, "".join(R.choice(words) + R.choice(" \n") for _ in range(R.randint(0, 200)))) for i in range(60)]
    texts += [(70, None), (71, ""), (72, " \n"), (73, texts[5][1]), (74, texts[5][1]), (5, texts[5][1]), (80, "w x " * 20_000), (None, "last")]
    got = fingerprints.version_fingerprints(frame(spark, [(i, t, "en") for i, t in texts])).collect()
    order = sorted(texts, key=lambda x: (x[0] is None, -(x[0] or 0)))
    exp = []
    for a, b in zip(order, order[1:] + order[:1]):
        t, o = a[1] or "", b[1] or ""
        e = t[:len(t) - len(t) // 2] + o[:len(t) // 2]
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        exp.append((str(a[0]), len(t), hashlib.sha256(e.encode()).hexdigest(),
                    round(like(piece_set(t), piece_set(e)), 9), round(like(piece_set(t), piece_set(o)), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(exp)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[73] == prints[74] == prints[5] and prints[70] == prints[71] == prints[72]
    assert fingerprints.version_fingerprints(frame(spark, [])).count() == 0
    only = fingerprints.version_fingerprints(frame(spark, [(1, "one two three four", "en")])).first()
    assert only.near_next == 1.0


def test_peeling_recovers_the_differences():
    R = np.random.default_rng(1)
    for size in (0, 5, 40, 700):
        a, b = R.integers(1, 2 ** 62, (2, size)).astype(np.uint64)
        both = R.integers(1, 2 ** 62, 300).astype(np.uint64)
        x, y = np.concatenate([a, both]), np.concatenate([b, both])
        owner, digest, sign = fingerprints.differences((np.zeros(len(x), int), x), (np.zeros(len(y), int), y), 1)
        assert set(digest[sign > 0].tolist()) == set(a.tolist()) and set(digest[sign < 0].tolist()) == set(b.tolist())


def test_suffix_automaton_accepts_exactly_the_substrings():
    R = random.Random(8)
    s = [R.randint(1, 3) for _ in range(40)]
    states = language_id.suffix_automaton(s)
    subs = {tuple(s[i:j]) for i in range(41) for j in range(i, 41)}
    for _ in range(500):
        w = tuple(R.randint(1, 3) for _ in range(R.randint(0, 6)))
        at = 0
        for c in w:
            at = states[at].get(c) if at is not None else None
        assert (at is not None) == (w in subs)


def test_phrases_against_a_plain_parse():
    samples = {"x": ["the cat sat on the mat"], "y": ["der hund lag auf dem bett"]}
    m = language_id.Model(samples)
    texts = ["the mat sat", "Hund, auf!", "zzz", "qthe", "a" * 700, "12 34"]
    found, _ = m.phrases(texts)
    for text, row in zip(texts, found):
        symbols = m.coded(language_id.code_points([text])[0]).tolist()
        for k, lang in enumerate(m.langs):
            sample = m.samples[lang].tolist()
            subs = {tuple(sample[i:j]) for i in range(len(sample)) for j in range(i + 1, len(sample) + 1)}
            n = 0
            for at in range(0, len(symbols), language_id.BLOCK):
                block = symbols[at:at + language_id.BLOCK]
                i = 0
                while i < len(block):
                    j = i + 1
                    while j < len(block) and tuple(block[i:j + 1]) in subs:
                        j += 1
                    n += 1
                    i = j
            assert row[k] == n, (text, lang)


def test_phrases_go_on_across_blocks():
    R = random.Random(12)
    samples = {"x": ["abab" * 90 + "caba" * 40], "y": ["".join(R.choice("abc") for _ in range(400))]}
    m = language_id.Model(samples)
    texts = ["ab" * 2000, "".join(R.choice("abc ") for _ in range(5000)), "caba" * 700 + "b", "a" * 257, "", "abab" * 64,
             "".join(R.choice("ab") for _ in range(3 * language_id.BLOCK))]
    found, _ = m.phrases(texts)
    for text, row in zip(texts, found):
        symbols = bytes(m.coded(language_id.code_points([text])[0]))
        for k, lang in enumerate(m.langs):
            sample, n, i = bytes(m.samples[lang]), 0, 0
            while i < len(symbols):
                j = i + 1
                while j < len(symbols) and symbols[i:j + 1] in sample:
                    j += 1
                n, i = n + 1, j
            assert row[k] == n, (text[:20], lang)


def test_samples_take_even_shares_of_their_texts():
    m = language_id.Model({"x": ["a" * 1000, "b" * 50, "c" * 1000]}, sample_chars=450)
    codes, counts = np.unique(m.samples["x"], return_counts=True)
    assert sorted(counts.tolist()) == [50, 200, 200]
    assert language_id.evenly(np.array([], int), 5) == 0


def test_language_id_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, ~language_id.held_out())
    rows = docs.select("lang", language_id.held_out().alias("out"), language_id.identify(model, F.col("text")).alias("p")).collect()
    tested = [r for r in rows if r.out]
    assert len(tested) > 100 and sum(r.p.lang == r.lang for r in tested) / len(tested) > 0.95
    odd = frame(spark, [(1, None, "en"), (2, "", "en"), (3, "123 !!", None), (4, "the and of", "en"), (None, "und der", "de")])
    got = {r.doc_id: r.p for r in odd.select("doc_id", language_id.identify(model, F.col("text")).alias("p")).collect()}
    assert [got[i].lang for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= p.score <= 1 for p in got.values())
    kept = language_id.drop_unidentified(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {4, None}
    untrained = language_id.fit(odd, F.lit(False))
    assert {r.p.lang for r in odd.select(language_id.identify(untrained, F.col("text")).alias("p")).collect()} == {"und"}


def test_language_sample_holds_distinct_texts(spark):
    R = random.Random(2)
    words = {"en": ["the", "and", "house", "of", "was"], "de": ["der", "und", "haus", "von", "war"]}
    few = [" ".join(R.choice(words["en"]) for _ in range(9)) for _ in range(3)]
    rows = [(i, few[i % 3], "en") for i in range(30_000)]  # a share of rows would expect 0.01 of the three texts
    rows += [(100_000 + i, "ein text und noch ein text", "de") for i in range(3000)]
    rows += [(200_000 + i, f"{'x' * (i + 1)} " + " ".join(R.choice(words["de"]) for _ in range(9)), "de") for i in range(300)]
    model = language_id.fit(frame(spark, rows), F.lit(True))
    assert model.langs == ["de", "en"]
    sizes = {k: len(v) for k, v in model.samples.items()}
    assert sizes["en"] == len(language_id.code_points(sorted(set(few)))[0])
    assert model.predict(["the house and", "das haus und der"])[0] == ["en", "de"]
    small = language_id.fit(frame(spark, rows), F.lit(True), sample_rows=2)
    assert small.langs == ["de", "en"]


def test_copies_take_one_place_of_the_sample(spark):
    copy = "gleicher text " * 20
    rows = [(i, copy, "de") for i in range(50)] + [(100 + i, f"{chr(97 + i) * 3} wort", "de") for i in range(20)]
    model = language_id.fit(frame(spark, rows), F.lit(True))
    exp = language_id.code_points(sorted({t for _, t, _ in rows}))[0]
    assert len(model.samples["de"]) == len(exp) and sorted(model.samples["de"]) == sorted(model.coded(exp))


def test_no_label_is_no_verdict(spark):
    rows = [(1, "words in a text", None), (2, None, "en"), (3, "12 !", None), (4, "", None), (None, "É", None), (2, "held out", "en")]
    docs = frame(spark, rows)
    model = language_id.fit(docs, ~language_id.held_out() & F.col("lang").isNull())
    assert model.langs == []
    kept = language_id.drop_unidentified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.text) for r in kept.collect()) == ["held out", "words in a text", "É"]


def test_license_scan(spark):
    mit = licenses.KNOWN["MIT"].replace("<year> <copyright holders>", "2031 Someone Else").replace("\n\n", "\n \n  ").replace('"', "'")
    rows = [(1, mit.upper(), "en"), (2, "Some text\nReleased under the MIT licence!!\nmore", "en"), (3, None, "en"), (4, "", None),
            (5, mit + " and more", "en"), (6, "LICENSED under CC BY-NC 4.0", "en"), (6, "LICENSED under CC BY-NC 4.0", "en"),
            (None, "?!", "en"), (7, "x " * 50_000, "en")]
    got = sorted(((r.doc_id or 0, r.license_id, r.line_licenses) for r in licenses.scan(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "MIT", ""), (2, None, "notice:MIT"), (3, None, ""), (4, None, ""), (5, None, ""),
                          (6, "notice:CC-BY-NC-4.0", "notice:CC-BY-NC-4.0"), (6, "notice:CC-BY-NC-4.0", "notice:CC-BY-NC-4.0"),
                          (0, None, ""), (7, None, "")], key=str)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_texts_with_and_without_title(spark):
    def wrapped(text, width):
        return "\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))

    mit = licenses.KNOWN["MIT"].replace("<year> <copyright holders>", "2031 Someone Else")
    bare = mit.split("\n\n", 1)[1]
    texts = dict(licenses.known_texts())
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense",
            "CC0-1.0"} <= set(texts)
    rows = [("MIT", bare), ("MIT", "The MIT License (MIT)\n\n" + bare), ("MIT", bare.replace("(c) 2031 Someone Else", "The Foo Authors"))]
    rows += [("MIT", wrapped(mit, w)) for w in range(32, 90)]
    rows += [(k, t) for k, t in licenses.known_texts() if ":" not in k]
    rows += [(k, "\n".join(" ".join(p.split()) for p in t.split("\n\n"))) for k, t in licenses.known_texts() if k in ("MPL-2.0", "Unlicense")]
    rows += [(None, "copyright notice and this permission notice"), (None, "Copyright 2020 Someone")]
    got = licenses.scan(frame(spark, [(i, t, "en") for i, (_, t) in enumerate(rows)])).collect()
    assert len(got) == len(rows) and {(rows[r.doc_id][0], r.license_id) for r in got if r.license_id != rows[r.doc_id][0]} == set()
    digests = {r.doc_id: r.canonical_digest for r in got}
    empty = hashlib.sha256(b"").hexdigest()
    assert digests[len(rows) - 1] == empty != digests[len(rows) - 2]


def test_known_licenses_are_a_table(spark):
    known = spark.createDataFrame([("b", "My terms"), ("a", "my  TERMS."), ("c", "Other terms"), ("d", "!!")], "license_id string, text string")
    got = licenses.scan(frame(spark, [(1, "MY TERMS", "en"), (2, "x\nother terms", "en"), (3, "", "en")]), known).collect()
    assert sorted((r.doc_id, r.license_id, r.line_licenses) for r in got) == [(1, "a", "a,b"), (2, None, "c"), (3, None, "")]
