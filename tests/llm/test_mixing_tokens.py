"""Mixing, token counts and BPE on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from cadence.llm import encoding, mixing, token_counts

ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, row int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "a b c", "en", "x", 5, "s", 1), (2, None, None, None, None, None, None), (3, "", "en", "x", 0, "s", 2),
            (4, "w " * 30_000, "en", "y", 60_000, "s", 3), (1, "a b c", "en", "x", 5, "s", 1), (None, "q r", "de", None, 3, "s", 4),
            (5, "a b c", "en", "x", 5, "s", 5), (6, " \t\n ", "en", "y", 4, "s", 6)]
    return spark.createDataFrame(rows, ODD)


def test_mix_of_odd_rows(odd):
    plan = mixing.plan_mix(odd).collect()
    assert len(plan) == 8
    by = {}
    for r in plan:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert by["x"][0].source_size == 9 and by["y"][0].source_size == 30_000 and by[None][0].source_size == 2
    assert by["x"][0].target == pytest.approx(27) and by[None][0].target == pytest.approx(6)
    assert sum(r.target for r in (by["x"][0], by["y"][0], by[None][0])) == pytest.approx(30_011)
    out = mixing.mix(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(r.copies for r in plan)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    R = random.Random(1)
    rows = [(i, "w " * R.randint(1, 300), "en", f"s{min(R.randint(0, 9), 4)}", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = mixing.plan_mix(docs)
    one, two = sorted(map(tuple, a.collect())), sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()))
    assert one == two
    for r in a.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) < 0.02 * r.g + 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], ODD)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert encoding.encode(none).count() == 0


def test_token_counts_match_the_library(spark, odd, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id}
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second run answers from the cache
        got = token_counts.token_counts(odd, cache_path=cache).collect()
        assert len(got) == 8
        for r in got:
            if r.doc_id:
                assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False))
                assert r.n_bytes == len(texts[r.doc_id].encode())
    assert spark.read.parquet(cache).count() == len(set(texts.values()) | {"q r"})


def test_segments_add_up():
    import public_tokenizers as P

    count, whole = token_counts.Counter(P.path("byte_bpe_50k.json")), token_counts._whole_counter(P.path("byte_bpe_50k.json"))
    assert count.additive and not token_counts.cuts_at_white_space(P.path("word_bpe_49k.json"))
    R = random.Random(5)
    letters = [*map(chr, [*range(33), 0x85, 0xA0, 0x2000, 0x200B, 0x2028, 0x3000, 0x660, 0x301, 0x1F600, 0x4E2D])] + \
        ["a", "1", "!", ".", " ", "\n", "<|endoftext|>", "'s", "the", "ing "]
    for _ in range(3000):
        s = "".join(R.choice(letters) for _ in range(R.randint(0, 30)))
        assert count([s]) == whole([s]), s


def test_bpe_equals_tiktoken_and_decodes(spark, odd):
    import public_tokenizers as P
    import tiktoken

    v = encoding.vocabulary("byte_bpe_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    R = random.Random(7)
    letters = [*map(chr, [*range(33), 0x85, 0xA0, 0x2000, 0x3000, 0x301, 0x1F600, 0x4E2D])] + ["a", "st", "1", "! ", "'ll", "the "]
    texts = ["".join(R.choice(letters) for _ in range(R.randint(0, 40))) for _ in range(2000)]
    texts += ["abcd" * 20_000, "".join(R.choice("abcdefgh") for _ in range(50_000)), "é" * 5000, " " * 3000]
    for s in texts:
        ids = v.encode(s)
        assert ids == ref.encode_ordinary(s)
        assert v.decode(ids) == s.encode()
    rows = encoding.encode(odd)
    back = encoding.decode(rows).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())


def test_rank_queue_pops_in_order():
    R = random.Random(2)
    q, held = encoding.RankQueue(50_000), []
    for _ in range(5000):
        if held and R.random() < 0.5:
            rank, positions = q.pop()
            low = min(held)[0]
            assert rank == low and sorted(positions) == sorted(p for r, p in held if r == low)
            held = [x for x in held if x[0] != low]
        else:
            x = (R.randrange(50_000), R.randrange(99))
            q.push(*x)
            held.append(x)


def test_worker_forgets_what_another_operator_keeps():
    from cadence.llm import _worker, encoding

    v = encoding.vocabulary("byte_bpe_50k.tiktoken")
    _worker.begin("encoding")
    assert encoding.vocabulary("byte_bpe_50k.tiktoken") is v
    _worker.begin("language_id")
    assert not encoding._loaded
    assert encoding.vocabulary("byte_bpe_50k.tiktoken").encode("a b") == v.encode("a b")
