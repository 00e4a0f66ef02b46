"""Conversation prefix trie against a plain trie of whole conversations."""

import hashlib
import random
import zlib

import pytest

from cadence.llm import prefix_trie as T


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))]
           for c, v in convs.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        path = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        ends = sorted(c for c, last in members if last)
        out.append((min(members)[0], len(p), min(nodes[p[:-1]])[0] if p else None, len(members), len(kids),
                    sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r in below) for q in below),
                    sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 - 200
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yes", "", None, "é🙂x"])))
    rows += [(5000 + i, t, "user", f"same {t}") for i in range(0, 700, 100) for t in range(6)]
    rows += [(7, None, "user", "null first"), (7, 1, "a", "tie"), (7, 1, "b", "tie"), (7, 1, "b", "tie"), (None, 0, "user", "nobody")]
    return rows


def trie(spark, rows, shards):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, path string").repartition(3)
    return sorted((tuple(r) for r in T.prefix_trie(T.rebuilt_paths(T.conversation_paths(df)), shards).collect()), key=repr)


@pytest.mark.parametrize("shards", [1, 3, 8, 40])
def test_against_a_plain_trie(spark, shards):
    rows = conversations(shards, 90)
    assert trie(spark, rows, shards) == plain(rows)


def test_one_path_of_many_conversations_over_all_shards(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    rows = [(c * 100, t, "user", "same") for c in range(150) for t in range(3)] + [(c * 100 + 20_000, 0, "user", "same") for c in range(40)]
    got = trie(spark, rows, 8)
    assert got == plain(rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[1])] == [190, 190, 150, 150]


def test_longer_than_a_splitter(spark, monkeypatch):
    monkeypatch.setattr(T, "SPLITTER_TURNS", 2)
    rows = [(c * 100, t, "user", f"{t if t < 4 else c % 3}") for c in range(60) for t in range(4 + c % 4)]
    assert trie(spark, rows, 6) == plain(rows)


def test_empty_and_turnless(spark):
    assert trie(spark, [], 4) == []
    # a conversation that loses its only turns to an absent first of its hundred
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(c, 0, "user", "gone")]
    assert trie(spark, rows, 4) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_walk_holds_one_path(spark):
    rows = [(0, i, [b"%016d" % k for k in range(5)], [1] * 5) for i in range(10)]
    out = list(T.walk_shards(iter(rows), T.Skeleton([])))
    assert [r[0] for r in out].count(0) == 4 and out[-1][0] == 1 and out[-1][5] == 10
