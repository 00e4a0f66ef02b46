"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of its bytes. Every adjacent pair that the
vocabulary can merge stands in the bucket of its merge rank; a bitmap over the
ranks, with a bitmap of its non-zero words above it, finds the lowest occupied
rank by two find-first-set steps. Popping a
bucket takes its positions from left to right; entries whose pair has changed
since are skipped. Each merge pushes at most two new pairs, so a pre-token of
n bytes costs O(n) queue steps whatever its length.

Texts are cut at the vocabulary's pattern; equal pre-tokens are encoded once
per worker, which remembers up to ``CACHE`` of them until a task of another
operator starts there.

Defined results: null and empty texts have no tokens and decode to nothing;
a text of any length is encoded whole; rows are independent of each other, so
repeated rows, ties, null ids and extra columns pass through unchanged, and an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._tables import ready
from cadence.llm._worker import begin, keeps

#: Pre-tokens that a worker remembers before it starts anew.
CACHE = 1_200_000
#: Remembered strings are at most this long.
CACHE_CHARS = 64

#: Neighbours in a fresh linked list, for short pre-tokens.
AFTER, BEFORE = list(range(1, 257)), list(range(-1, 255))


class RankQueue:
    """Buckets of positions by rank under a bitmap of ``WIDTH``-bit words and a
    word over the words (one more level would serve 2**24 ranks and more)."""

    WIDTH = 8
    BITS = [1 << i for i in range(1 << WIDTH)]

    def __init__(self, n_ranks: int):
        self.words = [0] * ((n_ranks >> self.WIDTH) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w = rank >> 8
        word = self.words[w]
        if not word:
            self.top |= 1 << w
        self.words[w] = word | self.BITS[rank & 255]

    def pop(self) -> tuple[int, list[int]]:
        """The lowest occupied rank and its positions, by two find-first-set steps."""
        w = (self.top & -self.top).bit_length() - 1
        word = self.words[w]
        low = word & -word
        self.words[w] = word = word ^ low
        if not word:
            self.top ^= 1 << w
        rank = (w << 8) | (low.bit_length() - 1)
        return rank, self.buckets.pop(rank)


class Pretokens(dict):
    """Ids of the pre-tokens met so far; a new one is encoded where it is asked for, and kept if short."""

    def __init__(self, encode: Callable[[bytes], tuple[int, ...]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece.encode())
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids


class Vocabulary:
    """Merge ranks of a byte-level vocabulary; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = [ranks[bytes([b])] for b in range(256)]
        # the rank of each pair of tokens that makes a token
        self.pairs = {(x, y): r for t, r in ranks.items() for i in range(1, len(t))
                      if (x := ranks.get(t[:i])) is not None and (y := ranks.get(t[i:])) is not None}
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.pretokens = Pretokens(self.encode_bytes)

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        # the steps of RankQueue.push and RankQueue.pop stand here in line: most pre-tokens are short,
        # and calls would take longer than the steps
        pair_rank, bits = self.pairs.get, RankQueue.BITS
        buckets, words, top = self.queue.buckets, self.queue.words, 0
        ids = [self.single[b] for b in piece]
        n = len(ids)
        if n < len(AFTER):
            right, left = AFTER[:n], BEFORE[:n]
        else:
            right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        for i, r in enumerate(map(pair_rank, zip(ids, ids[1:]))):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> 8
                    if not words[w]:
                        top |= bits[w] if w < 256 else 1 << w
                    words[w] |= bits[r & 255]
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            low = word & -word
            words[w] = word = word ^ low
            if not word:
                top ^= 1 << w
            rank = (w << 8) | (low.bit_length() - 1)
            positions = buckets.pop(rank)
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                j = right[i]
                if j >= n or pair_rank((ids[i], ids[j])) != rank:
                    continue  # stale: one of the two has been merged since
                ids[i], ids[j] = rank, -1
                k = right[i] = right[j]
                h = left[i]
                if k < n:
                    left[k] = i
                    r = pair_rank((rank, ids[k]))
                    if r is not None:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            w = r >> 8
                            if not words[w]:
                                top |= 1 << w
                            words[w] |= bits[r & 255]
                if h >= 0:
                    r = pair_rank((ids[h], rank))
                    if r is not None:
                        if r in buckets:
                            buckets[r].append(h)
                        else:
                            buckets[r] = [h]
                            w = r >> 8
                            if not words[w]:
                                top |= 1 << w
                            words[w] |= bits[r & 255]
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> list[int]:
        known = self.pretokens
        if len(known) > CACHE:
            known.clear()
        return list(chain.from_iterable(map(known.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


_loaded: dict[tuple[str, str], Vocabulary] = {}
keeps("encoding", _loaded.clear)


def vocabulary(name: str, pattern: str | None = None) -> Vocabulary:
    """The vocabulary file ``name`` of the installed public tokenizers, once per worker."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN if pattern is None else pattern
    if (name, pattern) not in _loaded:
        with open(public_tokenizers.path(name), "rb") as f:
            _loaded[name, pattern] = Vocabulary(read_ranks(f), pattern)
    return _loaded[name, pattern]


def encode(docs: DataFrame, vocab: str = "byte_bpe_50k.tiktoken", pattern: str | None = None,
           text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, and the
    ``ids`` themselves if ``with_ids``.

    ``ids_sha256`` digests the decimal ids joined by one space,
    ``decoded_sha256`` the bytes that the ids decode to.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("encoding")
        gc.disable()  # the remembered tuples hold no cycles; walking them again and again costs as much as encoding
        try:
            v = vocabulary(vocab, pattern)
            digits = {i: str(i) for i in v.bytes_of}
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    counts, ids_sum, text_sum, lists = [], [], [], []
                    for text in part.column("t"):
                        text = text.as_py()
                        ids = v.encode(text) if text else []
                        counts.append(len(ids))
                        ids_sum.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                        text_sum.append(hashlib.sha256(v.decode(ids)).hexdigest())
                        if with_ids:
                            lists.append(ids)
                    cols = [part.column("d"), pa.array(counts, pa.int64()), pa.array(ids_sum, pa.string()),
                            pa.array(text_sum, pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    if with_ids:
                        cols.append(pa.array(lists, pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names=names)
        finally:
            gc.enable()

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocab: str = "byte_bpe_50k.tiktoken", ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``rows`` with the text that ``ids_col`` decodes to (null for null ids;
    byte sequences that are no UTF-8 become replacement characters)."""
    ready(rows.sparkSession)

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        v = vocabulary(vocab)
        return pa.array([None if x is None else v.decode(x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return rows.withColumn(out_col, text_of(F.col(ids_col)))
