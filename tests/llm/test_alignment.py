"""Token alignment against a plain walk over both token lists."""

import hashlib
import random

import numpy as np
import pytest

from cadence.llm import alignment as L

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_tokens(text):
    """(ids, bytes) of both sides by the libraries themselves, or None."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "kept"):
        t = Tokenizer.from_file(P.path(A))
        t.encode_special_tokens = True
        plain_tokens.kept = t, sentencepiece.SentencePieceProcessor(model_file=P.path(B))
    t, sp = plain_tokens.kept
    if not text:
        return None
    chars = L._byte_level()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    a_bytes = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    return a, a_bytes, b, b_bytes


def plain(rows):
    """(doc_id, n_a, ..., groups_sha256) of every row by walking byte for byte."""
    from collections import Counter

    done, links = [], Counter()
    for d, text in rows:
        got = plain_tokens(text)
        if got is None:
            done.append((d, 0, 0, [], []))
            continue
        a, ab, b, bb = got
        groups, pairs, ga, gb, i, j, at_a, at_b = [], [], [], [], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                ga.append(a[i]); at_a += len(ab[i]); i += 1
            else:
                gb.append(b[j]); at_b += len(bb[j]); j += 1
            if at_a == at_b:
                groups.append((ga, gb)); pairs.append((ga[-1], gb[-1])); ga, gb = [], []
        links.update(pairs)
        done.append((d, len(a), len(b), groups, pairs))
    top = {}
    for (x, y), n in links.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d, na, nb, groups, pairs in done:
        s = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, na, nb, len(groups), len(pairs), sum(links[p] == top[p[1]] for p in pairs), sum(links[p] for p in pairs),
                    hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return out


TEXTS = [None, "", " ", "  ", "a", "Hello world, hello worlds!", "two  spaces   here ", "\n\nline one\n line two\t\tx \n", "x;\r\n}\r\n  y",
         "naïve façade — “quoted” 漢字かな 한국어 🙂🙂", "<|endoftext|> and <s> </s> <0x41> <unk>", "▁marked▁ text", "a b　c",
         "\x00\x01 nul", "Hello world, hello worlds!", "aaaa" * 400, "1234567890" * 30, "Übergrößenträger " * 50, "\r\r a\r b",
         "ﬁne é café", "\t", "tail\n"]


@pytest.mark.parametrize("steps", [1, 2, 7, 64, L.PIECE_STEPS])
def test_pieces_of_any_size_align_alike(spark, steps):
    rng = random.Random(steps)
    words = ["the", "and", "über", "Straße", "\n", "  ", "don't", "é", "漢", ";\r", "12", "🙂"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    rows += [(100 + i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(40)]
    rows += [(500, "".join(rng.choices(words, k=4000)))]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows], "doc_id bigint, text string, block string, pairs int").repartition(3)
    got = [tuple(r) for r in L.align(docs, steps=steps).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_blocks_join_their_counts(spark, monkeypatch):
    rows = [(i, "the cat sat " * (i % 7) + "on a mat") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = L.align(docs, with_groups=True).orderBy("doc_id").collect()
    assert [tuple(r)[:8] for r in got] == plain(rows)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got)


def test_empty_table_and_texts_without_tokens(spark):
    assert L.align(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    assert sorted(map(tuple, L.align(docs).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_overlaps_tile_the_text(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = L.overlaps(spark.createDataFrame(rows, "doc_id bigint, text string"), steps=5).collect()
    for d, text in rows:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.from_byte)
        if not mine:
            assert plain_tokens(text) is None
            continue
        assert [r.from_byte for r in mine] == [0] + [r.to_byte for r in mine[:-1]]
        assert mine[-1].to_byte == len((" " + text).encode()) and mine[-1].common
        a, _, b, _ = plain_tokens(text)
        for ids, col in ((a, "a_id"), (b, "b_id")):
            seen = [r[col] for r in mine]
            assert [x for k, x in enumerate(seen) if k == 0 or x != seen[k - 1]] == [x for k, x in enumerate(ids) if k == 0 or x != ids[k - 1]]
        assert [r.group for r in mine] == [sum(x.common for x in mine[:k]) for k in range(len(mine))]


def test_diagonals_give_equal_work_and_keep_equal_ends():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 60, rng.integers(0, 30))) for _ in range(2))
        i, j = L.diagonals(a, b, 4)
        assert i[0] == j[0] == 0 and i[-1] == len(a) and j[-1] == len(b)
        assert ((np.diff(i) + np.diff(j)) <= 5).all()
        pieces = [L.merge_piece(a, b, at) for at in zip(i[:-1], i[1:], j[:-1], j[1:])]
        ends = [e for p in pieces for e in p.end.tolist()]
        assert ends == sorted(set(a.tolist()) | set(b.tolist()))
        assert [e for p in pieces for e in p.end[p.common].tolist()] == sorted(set(a.tolist()) & set(b.tolist()))
