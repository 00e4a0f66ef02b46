"""Quality scores against a plain computation and on held-out documents."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cadence.llm import _bytes, quality as Q

SF = "/root/testdata/sf0.01"


def plain_vector(text):
    """The feature vector of one text, count by count."""
    data = (text or "").encode()
    mixed = lambda x: int(_bytes.mix(np.array([x], np.uint64))[0])
    grams, shapes, repeats = np.zeros(Q.TRIGRAMS), np.zeros(Q.SHAPES), np.zeros(Q.REPEATS)
    for a, b, c in zip(data, data[1:], data[2:]):
        grams[mixed(a << 16 | b << 8 | c) % Q.TRIGRAMS] += 1
    runs = []
    for b in data:
        k = int(Q._CLASS[b])
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    code = [k * 4 + min(n, 3) for k, n in runs]
    for a, b, c in zip(code, code[1:], code[2:]):
        shapes[mixed(a << 10 | b << 5 | c) % Q.SHAPES] += 1
    words = [w for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    if words:
        again = sum(x == y for x, y in zip(words, words[1:]))
        for k, share in ((0, math.log1p(len(set(words))) / math.log1p(len(words))), (8, again / len(words))):
            low = int(share * 6.999)
            repeats[k + low] += 1 - (share * 6.999 - low)
            repeats[k + min(low + 1, 7)] += share * 6.999 - low
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    return np.concatenate([unit(np.log1p(grams)), unit(np.log1p(shapes)), unit(repeats)])


TEXTS = [None, "", " ", "a", "ab", "abc", "same same same word", "THE!! END!!\nof $$$ it", "é漢🙂 12,5 x\r\ny", "A\x00b \x0b c", "x " * 700,
         "".join(random.Random(3).choices("abcdef \nXY1,é", k=3000))]


@pytest.mark.parametrize("chunk", [64, 1000, _bytes.CHUNK_BYTES])
def test_features_of_any_block(monkeypatch, chunk):
    if chunk > 1000:  # whole texts
        got = np.concatenate(list(Q.features(pa.array(TEXTS))))
        assert np.allclose(got, [plain_vector(t) for t in TEXTS], atol=2e-6)
        return
    monkeypatch.setattr(Q, "ROWS", 3)
    got = np.concatenate(list(Q.features(pa.array(TEXTS).slice(0, len(TEXTS)))))
    assert np.allclose(got, [plain_vector(t) for t in TEXTS], atol=2e-6)


def test_slices_of_a_long_text_keep_words_whole(monkeypatch):
    text = " ".join(random.Random(4).choices(["alpha", "beta", "gamma", "delta!"], k=500))
    whole = next(Q.features(pa.array([text])))
    monkeypatch.setattr(Q, "CHUNK_BYTES", 200)
    parts = next(Q.features(pa.array([text])))
    assert np.allclose(whole[0, -Q.REPEATS:], parts[0, -Q.REPEATS:], atol=0.2)
    data = np.frombuffer(text.encode(), np.uint8)
    pieces = list(Q._slices(data))
    assert b"".join(p.tobytes() for p in pieces) == text.encode() and all(p[-1] == 32 for p in pieces[:-1])
    assert list(map(len, Q._slices(np.full(450, 97, np.uint8)))) == [200, 200, 50]


def test_votes_against_all_products():
    rng = np.random.default_rng(1)
    x = rng.random((40, Q.WIDTH)).astype("f4")
    proj = rng.standard_normal((Q.WIDTH, 5)).astype("f4")
    m = Q.Model(proj, Q._unit(rng.standard_normal((60, 5)).astype("f4")), rng.integers(0, 2, 60).astype(float), rng.random(60), 0.4)
    got = m.score(x)
    for row, s in zip(x, got):
        z = row @ proj
        cos = [(float(z / np.linalg.norm(z) @ v), k) for k, v in enumerate(m.vectors)]
        near = sorted(cos, reverse=True)[:Q.NEIGHBOURS]
        vote = [(max(c, 0) * m.weights[k], m.labels[k]) for c, k in near]
        total = sum(v for v, _ in vote)
        assert math.isclose(s, sum(v * y for v, y in vote) / total if total else 0.4, abs_tol=1e-4)
    assert Q.Model(proj, m.vectors[:4], m.labels[:4], m.weights[:4], 0.4).score(x).shape == (40,)


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels, ~Q.held_out())
    rows = Q.score(docs, model).select("doc_id", "score").join(labels, "doc_id").collect()
    out = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 500 and np.mean([(r.score >= 0.3) == (r.quality == 1) for r in out]) > 0.95


def test_labels_of_held_out_documents_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.filter("doc_id < 300")
    from pyspark.sql import functions as F
    other = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, Q.score(docs, Q.fit(docs, x, ~Q.held_out())).select("doc_id", "score").collect())) for x in (labels, other))
    assert a == b


def test_nulls_empty_texts_and_missing_labels(spark):
    rows = [(1, "good words here"), (2, None), (3, ""), (4, "GOOD!! WORDS!!"), (4, "GOOD!! WORDS!!"), (None, "good words"), (6, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id bigint, text string, digest string")
    marks = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (99, 0), (2, 1), (2, 0)], "doc_id bigint, quality int")
    from pyspark.sql import functions as F
    model = Q.fit(docs, marks, F.lit(True))
    got = [r.score for r in Q.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got)
    assert got[1] == got[2] == model.prior == 0.5 and got[0] > 0.3 > got[3] == got[4]
    none = Q.fit(docs, marks.filter("quality > 5"), F.lit(True))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), model).count() == 0
