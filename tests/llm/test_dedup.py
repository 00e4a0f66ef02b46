"""Near-duplicate components and repeated spans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from cadence.llm import _bytes, near_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, rest string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in texts], SCHEMA)


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, k, percent):
    sets = [shingles(t, k) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(root(i), []).append(i)
    out = [None] * len(texts)
    for g in groups.values():
        ids = [texts[i][0] for i in g if texts[i][0] is not None]
        for i in g:
            out[i] = (texts[i][0], len(sets[i]), min(ids) if ids else None)
    return out


def copies(seed, n):
    R = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [R.choice(words) for _ in range(120)]
    out = []
    for i in range(n):
        if R.random() < 0.5:  # copies with few or many edits: links lie on both sides of the threshold
            t = list(base)
            for _ in range(R.randint(0, 9)):
                t[R.randrange(len(t))] = R.choice(words)
        else:
            t = [R.choice(words) for _ in range(R.randint(0, 60))]
        out.append((i, " ".join(t)))
    return out


def test_components_against_brute_force(spark):
    texts = copies(3, 160)
    texts += [(200, None), (201, ""), (202, " \n"), (203, "One two"), (204, "one TWO"), (205, "one"), (None, "one two"),
              (None, "lone words here now today"), (206, "Z " * 9000), (206, "Z " * 9000), (3, texts[3][1])]
    got = near_dedup.near_duplicates(frame(spark, texts), shingle_words=4).collect()
    exp = brute_components(texts, 4, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(exp, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_duplicates(frame(spark, texts), shingle_words=4)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(
        (str(i), t or "") for (i, t), e in zip(texts, exp) if i == e[2])


def test_components_find_links_between_stars(spark):
    for seed in (11, 12):
        texts = copies(seed, 120)
        got = near_dedup.near_duplicates(frame(spark, texts), shingle_words=5).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(texts, 5, 80))


def linked_past_the_leader(base):
    """Three texts: the first is the leader of a bucket; the other two link with each other and not with it."""
    def but(*places):
        return [f"{w}-" if i in places else w for i, w in enumerate(base)]

    return [" ".join(but(*range(0, 30, 10))), " ".join(but(45, 46, 47, 60)), " ".join(but(45, 46, 47, 60, 90))]


def test_repeated_rows_keep_their_links(spark):
    R, once, often = random.Random(21), [], []
    for g in range(30):  # one band of one coordinate: where the three share it, only rare shingles can link the last two
        first, second, third = linked_past_the_leader([f"g{g}w{R.randrange(10 ** 6)}" for _ in range(120)])
        rows = [(10 * g, first), (10 * g + 1, second), (10 * g + 2, third)]
        once += rows
        often += rows[:1] + rows[1:2] * 3 + rows[2:] * 2
    found = [{(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(
        frame(spark, t), shingle_words=4, bands=1, rows=1).collect()} for t in (once, often)]
    assert found[0] == found[1] and sum(i != c for i, c in found[0]) > 20


def test_one_row_of_each_component(spark):
    word = "one two three four five six"
    texts = [(7, word)] * 3 + [(9, word), (7, "other words of this id here"), (7, "other words of this id here now"),
             (None, "no id at all here"), (None, "no id at all here"), (None, "No id at all here"), (None, None), (None, None),
             (5, ""), (5, ""), (6, "?"), (None, "no words in common with any")]
    docs = frame(spark, texts)
    got = near_dedup.near_duplicates(docs, shingle_words=2, one_row=True).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, brute_components(texts, 2, 80)))
    kept = sorted((str(r.doc_id), str(r.text).lower()) for r in
                  near_dedup.drop_near_duplicates(docs, shingle_words=2, one_row=True).collect())
    assert sum(r.kept for r in got) == len(kept)
    late = [k for k in kept if k[1].startswith("other words")]
    assert len(late) == 1
    assert [k for k in kept if k not in late] == sorted([("7", word), ("None", "no id at all here"), ("None", "none"), ("5", ""),
                                                         ("6", "?"), ("None", "no words in common with any")])


def brute_spans(texts, size):
    first = {}
    order = {i: (1 << 62 if d is None else d) for i, (d, _) in enumerate(texts)}
    raw = [(t or "").encode() for _, t in texts]
    for i, b in enumerate(raw):
        for p in range(len(b) - size + 1):
            g = b[p:p + size]
            first[g] = min(first.get(g, 1 << 63), order[i])
    out = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p:p + size]] < order[i]:
                gone[p:p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((texts[i][0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def passages():
    R = random.Random(9)
    common = "".join(R.choice("abcdé ") for _ in range(80))
    texts = []
    for i in range(60):
        t = "".join(R.choice("abcdefgh ") for _ in range(R.randint(0, 150)))
        if R.random() < 0.5:
            t += common[R.randint(0, 20):][:R.randint(20, 80)] + "z" * R.randint(0, 3)
        if R.random() < 0.2 and texts:
            t = R.choice(texts)[1]
        texts.append((R.randint(0, 80), t))
    return texts + [(90, None), (91, ""), (None, common), (92, common), (93, "ab" * 40), (94, "ab" * 40)]


@pytest.mark.parametrize(("size", "base"), [(50, 25), (20, 3), (12, 12)])
def test_spans_against_brute_force(spark, passages, size, base):
    got = suffix_dedup.repeated_spans(frame(spark, passages), threshold=size, base=base).collect()
    exp = brute_spans(passages, size)
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == sorted(
        str(e[:5]) for e in exp)


@pytest.mark.parametrize(("size", "base"), [(50, 25), (12, 12)])
def test_spans_of_negative_ids_in_several_blocks(spark, passages, size, base):
    texts = [(None if i is None else i - 45, t) for i, t in passages]
    exp = sorted(str(e[:5]) for e in brute_spans(texts, size))
    for parts in (1, 7):
        got = suffix_dedup.repeated_spans(frame(spark, texts).repartition(parts), threshold=size, base=base).collect()
        assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got))) == exp


def test_ranges_follow_the_input_and_are_even(spark, passages, monkeypatch):
    R = np.random.default_rng(5)
    b = suffix_dedup.Block(R.integers(97, 123, 200_000).astype(np.uint8), np.array([0, 200_000]), np.array([1]), 25, 50)
    keys = np.unique(b.minima(b.windows(np.zeros(1, bool))))
    dealt = np.bincount(suffix_dedup.bucket_of_hash(keys, 40, 16).astype(int), minlength=16)
    assert dealt.max() < 1.3 * dealt.mean()
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", suffix_dedup.BLOCK_BYTES // 8)
    t, _, buckets = suffix_dedup._rounds(frame(spark, passages).repartition(5), 50, 25, "doc_id", "text")
    assert buckets >= 40
    got = suffix_dedup.repeated_spans(frame(spark, passages).repartition(5)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(
        str(e[:5]) for e in brute_spans(passages, 50))


def test_drop_repeats_keeps_columns(spark, passages):
    docs = frame(spark, passages)
    out = suffix_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    exp = sorted((str(e[0]), "None" if t is None else e[5].decode("utf-8", "ignore")) for e, (_, t) in zip(brute_spans(passages, 50), passages))
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == exp
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert all(r.rest == "x" for r in got)


def test_empty_table(spark):
    none = frame(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_duplicates(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert suffix_dedup.drop_repeats(none).count() == 0


def test_strings_that_rolling_sums_confuse(spark):
    """Thue-Morse words of two letters are alike modulo any power of two; they are different words and pieces."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    assert len(a) == 1024 and a != b
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    h = _bytes.slice_hashes(data, np.array([0, 1024, 2048]), np.array([1024, 2048, 3072]))
    assert h[0] == h[2] != h[1]
    rows = [(0, f"{a} {a} {b} {a}"), (1, f"{b} {b} {a} {b}"), (2, f"{a} {a} {b} {a}")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=4, percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 1), (2, 0)]


def test_kept_is_the_row_of_its_component(spark):
    rows = [(7, "one two three four five"), (7, "one two three four five"), (9, "one two three four five"), (3, "other words")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=4, percent=80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (7, 7, True), (7, 7, True), (9, 7, False)]
