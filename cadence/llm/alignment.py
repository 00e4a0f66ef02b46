"""Alignment of the tokens of two tokenizers by merge-path partitioning.

Texts of one block (a few megabytes, or one longer text) are tokenized by A
and by B, and the byte ends of both token streams are two sorted lists whose
merge cuts the bytes into overlaps of one A and one B token. Diagonal binary
searches cut that merge into pieces of equal work that know nothing of each
other (a long text is many pieces, many short texts are one); each piece emits
its overlaps, and the groups that cross the border of two pieces are stitched
by the running number of common ends. A text ends in both streams, so no group
leaves its text.

Both tokenizers are of the kinds whose tokens never reach from a character
that is no white space into white space after it; a text is cut there, and a
worker remembers the tokens of up to ``CACHE`` such segments. Vocabularies for
which that does not hold are given whole texts.

Corpus counts of id pairs come from one row for each block and distinct pair;
what every block needs of them returns to it by its number, so that neither
links nor counts meet in one place.

Defined results: null and empty texts, and texts whose joined A or B bytes are
not their own (with the space before them), have no tokens: zeros, no groups.
Texts of any length are aligned whole; repeated rows, ties and null ids are
rows of their own; extra columns are never read; an empty table gives an empty
result.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bytes import binary_column, chunks
from cadence.llm._tables import ready, stored
from cadence.llm._worker import begin, keeps
from cadence.llm.token_counts import WHITE

#: Segments that a worker remembers before it starts anew, and their longest length.
CACHE, CACHE_CHARS = 400_000, 64
#: New segments that are encoded as one string.
JOINED = 256
#: Bytes of text in a block (a longer text stands alone), and merge steps of a piece.
BLOCK_BYTES = 2 << 20
PIECE_STEPS = 1 << 18


class Side:
    """One tokenizer: ``encode(segments) -> id lists`` of texts that begin
    with white space or stand first, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], bytes_of: list[bytes], additive: bool, glue: str = ""):
        self.encode, self.bytes_of, self.additive = encode, bytes_of, additive
        self.glue = glue  # white space that a token may hold behind another character
        self.kind = np.dtype("<u2" if len(bytes_of) <= 1 << 16 else "<u4")
        self.lengths = np.array([len(b) for b in bytes_of], np.int64)
        self.known: dict[str, bytes] = {}

    def packed(self, text: str, ids: list[int]) -> bytes | None:
        """The ids as bytes, or None if they do not join to the text."""
        if b"".join(map(self.bytes_of.__getitem__, ids)) != text.encode():
            return None
        return np.array(ids, self.kind).tobytes()

    def learn(self, segments: set[str]) -> None:
        """Know the packed ids of all ``segments`` (None where they do not join
        to the segment). Those that end before white space are encoded many in
        one string and parted at their bytes."""
        known = self.known
        alone = [s for s in segments if s not in known]
        if self.additive:
            solid = [s for s in alone if s[-1] not in WHITE]
            alone = [s for s in alone if s[-1] in WHITE]
            parts = [solid[k:k + JOINED] for k in range(0, len(solid), JOINED)]
            texts = ["".join(part) for part in parts]
            for part, text, ids in zip(parts, texts, self.encode(texts)):
                packed = self.packed(text, ids)
                if packed is None:
                    alone += part
                    continue
                ends = np.cumsum(self.lengths[ids])
                want = np.cumsum([len(s.encode()) for s in part])
                cuts = ((np.searchsorted(ends, want) + 1) * self.kind.itemsize).tolist()
                known.update(zip(part, [packed[i:j] for i, j in zip([0] + cuts, cuts)]))
        known.update((s, self.packed(s, ids)) for s, ids in zip(alone, self.encode(alone)))

    def tidy(self, segments: set[str]) -> None:
        """Forget long segments, and all if there are too many."""
        if len(self.known) > CACHE:
            self.known.clear()
        for s in segments:
            if len(s) > CACHE_CHARS:
                self.known.pop(s, None)


def _byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def json_side(path: str) -> Side:
    """A byte-level tokenizer file of the ``tokenizers`` library."""
    from tokenizers import Tokenizer

    from cadence.llm.token_counts import cuts_at_white_space

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings are plain text
    of_char = _byte_level()
    added = set(t.get_added_tokens_decoder())
    size = max(t.get_vocab(with_added_tokens=True).values()) + 1
    bytes_of = [b""] * size
    for token, i in t.get_vocab(with_added_tokens=True).items():
        bytes_of[i] = token.encode() if i in added else bytes(map(of_char.__getitem__, token))
    return Side(lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)],
                bytes_of, cuts_at_white_space(path))


def piece_side(path: str) -> Side:
    """A ``sentencepiece`` model, which adds the space before a text itself."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    mark = "▁"
    bytes_of = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(mark, " ").encode() for i, p in enumerate(pieces)]
    space = sp.piece_to_id(mark)
    # segments are independent if no piece has a space behind another character, and other white space of longer
    # pieces does not begin a segment
    additive = all(mark not in p.lstrip(mark) for p in pieces)
    glue = "".join(sorted(set(WHITE[:5] + WHITE[6:]) & set("".join(p for p in pieces if len(p) > 1))))

    def encode(texts: list[str]) -> list[list[int]]:
        # the model adds a space: it stands for the one that a segment begins with;
        # before other white space it is a token of its own, which goes again
        bare = [t[1:] if t[0] == " " else t for t in texts]
        out = sp.encode(bare, num_threads=1)
        return [([space] if not b else ids) if t[0] == " " else ids[1:] for t, b, ids in zip(texts, bare, out)]

    return Side(encode, bytes_of, additive, glue)


_loaded: dict[str, Side] = {}
keeps("alignment", lambda: (_loaded.clear(), _strings.clear()))


def side(name: str) -> Side:
    """The tokenizer file ``name`` of the installed public tokenizers, once per worker."""
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _loaded:
        path = public_tokenizers.path(name)
        _loaded[name] = piece_side(path) if name.endswith(".model") else json_side(path)
    return _loaded[name]


@cache
def segments_of(glue: str) -> re.Pattern:
    """Segments that begin with white space; that in ``glue`` begins none behind another character."""
    more = f"(?:[{glue}][{WHITE}]*[^{WHITE}]*)*" if glue else ""
    return re.compile(f"[{WHITE}]*[^{WHITE}]+{more}|[{WHITE}]+")


# --- merge path ------------------------------------------------------------------


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of ``steps`` merge steps begin in the sorted lists ``a`` and
    ``b``: one binary search on each diagonal, all in step. Equal ends go A
    first, and are never parted between two pieces."""
    total = len(a) + len(b)
    cut = np.append(np.arange(0, total, steps), total)
    low = np.maximum(cut - len(b), 0)
    high = np.minimum(cut, len(a))
    while (open_ := low < high).any():
        i = (low + high) // 2
        j = cut - i - 1
        take = np.zeros(len(cut), bool)
        take[open_] = a[i[open_]] <= b[j[open_]]
        low = np.where(open_ & take, i + 1, low)
        high = np.where(open_ & ~take, i, high)
    i, j = low, cut - low
    tie = (i > 0) & (j < len(b))
    tie[tie] = a[i[tie] - 1] == b[j[tie]]
    return i, j + tie


class Overlaps(NamedTuple):
    """Overlaps of one A and one B token, in order: indexes of both tokens,
    the byte after the overlap, and whether both tokens end there."""

    a: np.ndarray
    b: np.ndarray
    end: np.ndarray
    common: np.ndarray


def merge_piece(a: np.ndarray, b: np.ndarray, at: tuple[int, int, int, int]) -> Overlaps:
    """The overlaps that end in one piece, from the ends ``a[i0:i1]`` and ``b[j0:j1]`` alone."""
    i0, i1, j0, j1 = at
    ends = np.concatenate([a[i0:i1], b[j0:j1]])
    order = np.argsort(ends, kind="stable")  # two runs: a merge
    merged = ends[order]
    from_a = order < i1 - i0
    last = np.ones(len(merged), bool)  # of two equal ends the second, B's, closes the overlap
    last[:-1] = merged[1:] != merged[:-1]
    done_a = np.cumsum(from_a)
    done_b = np.arange(1, len(merged) + 1) - done_a
    common = np.zeros(len(merged), bool)
    common[1:] = ~last[:-1]
    common, ends_a, ends_b = common[last], done_a[last], done_b[last]
    first = from_a[last]
    # tokens that end with the overlap, else those that go on behind it
    return Overlaps(i0 + ends_a - (common | first), j0 + ends_b - (common | ~first), merged[last], common)


def stitch(pieces: list[Overlaps]) -> tuple[Overlaps, np.ndarray]:
    """All overlaps and the group of each: a group goes on over the border of
    pieces until the next common end."""
    whole = Overlaps(*(np.concatenate(x) for x in zip(*pieces)))
    return whole, np.cumsum(whole.common) - whole.common


class Block:
    """The alignment of one block of texts."""

    def __init__(self, a: Side, b: Side, texts: list[str | None], steps: int = PIECE_STEPS):
        self.sides = a, b
        self.bytes = np.zeros(len(texts), np.int64)
        cut = segments_of(a.glue + b.glue)
        whole = {k: " " + text for k, text in enumerate(texts) if text}
        parts = {k: cut.findall(text) for k, text in whole.items()}
        streams: list[dict[int, bytes]] = []
        for side in self.sides:
            mine = parts if side.additive else {k: [text] for k, text in whole.items()}
            segments = set(chain.from_iterable(mine.values()))
            side.learn(segments)
            known, found = side.known.__getitem__, {}
            for k, p in mine.items():
                try:
                    found[k] = b"".join(map(known, p))
                except TypeError:  # a segment has other bytes
                    pass
            side.tidy(segments)
            streams.append(found)
        both = [k for k in streams[0] if k in streams[1]]
        for k in both:
            self.bytes[k] = len(whole[k].encode())
        self.a, self.b = (np.frombuffer(b"".join([s[k] for k in both]), side.kind).astype(np.int64) for s, side in zip(streams, self.sides))
        ends_a, ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        i, j = diagonals(ends_a, ends_b, steps)
        pieces = [merge_piece(ends_a, ends_b, at) for at in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist())]
        if not pieces:
            empty = np.zeros(0, np.int64)
            pieces = [Overlaps(empty, empty, empty, np.zeros(0, bool))]
        self.overlaps, self.group = stitch(pieces)
        # where each text ends in the two streams and in the links
        self.text_ends = np.cumsum(self.bytes)
        link = self.overlaps.common
        self.link_a, self.link_b = self.a[self.overlaps.a[link]], self.b[self.overlaps.b[link]]
        self.bounds_a, self.bounds_b, self.bounds_links = (
            np.append(0, np.searchsorted(x, self.text_ends, "right")) for x in (ends_a, ends_b, self.overlaps.end[link]))

    def group_strings(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each text: ids of A and of B by group."""
        n_groups = int(self.overlaps.common.sum())
        # groups of the tokens: that of the last overlap of each
        group_a, group_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        group_a[self.overlaps.a], group_b[self.overlaps.b] = self.group, self.group
        upto_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
        before_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=n_groups)))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        # the separator behind a token: none, comma, bar or semicolon
        sep_a = np.ones(len(self.a), np.int64)
        sep_a[:-1] += group_a[1:] != group_a[:-1]
        sep_a[-1:] = 2
        sep_b = np.ones(len(self.b), np.int64)
        sep_b[:-1] += 2 * (group_b[1:] != group_b[:-1])
        sep_b[self.bounds_b[1:][self.bytes > 0] - 1] = 0
        code[np.arange(len(self.a)) + before_b[group_a]] = self.a * 4 + sep_a
        code[np.arange(len(self.b)) + upto_a[group_b]] = self.b * 4 + sep_b
        bounds = (self.bounds_a + self.bounds_b).tolist()
        known = _spelled(max(len(s.bytes_of) for s in self.sides))
        return ["".join(map(known.__getitem__, code[s:e].tolist())) for s, e in zip(bounds, bounds[1:])]


_strings: list[str] = []


def _spelled(size: int) -> list[str]:
    """Decimal ids with each separator, at ``id * 4 + separator``."""
    if len(_strings) < size * 4:
        _strings[:] = [f"{i}{s}" for i in range(size) for s in ("", ",", "|", ";")]
    return _strings


def _blocks(batches: Iterator[pa.RecordBatch], a: str, b: str, steps: int) -> Iterator[tuple[pa.Array, Block]]:
    begin("alignment")
    gc.disable()  # what is remembered holds no cycles
    try:
        for batch in batches:
            _, offsets = binary_column(batch.column("t"))
            for i, j in chunks(offsets, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                yield part.column("d"), Block(side(a), side(b), part.column("t").to_pylist(), steps)
    finally:
        gc.enable()


def overlaps(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text_col: str = "text",
             id_col: str = "doc_id", steps: int = PIECE_STEPS) -> DataFrame:
    """``doc_id, group, a_id, b_id, from_byte, to_byte, common``: one row for
    each overlap of an A and a B token, bytes counted in the text with its
    space; ``common`` where both end (the overlap closes its group)."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for ids, block in _blocks(batches, a, b, steps):
            o = block.overlaps
            text = np.searchsorted(block.text_ends, o.end, "left")
            start = np.append(0, block.text_ends)[text]
            begins = np.append(0, o.end[:-1])[:len(o.end)]
            first = np.append(0, block.bounds_links[1:])[text]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(text)), pa.array(block.group - first), pa.array(block.a[o.a]), pa.array(block.b[o.b]),
                 pa.array(begins - start), pa.array(o.end - start), pa.array(o.common)],
                names=["doc_id", "group", "a_id", "b_id", "from_byte", "to_byte", "common"])

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(
        run, f"doc_id {kind}, group bigint, a_id bigint, b_id bigint, from_byte bigint, to_byte bigint, common boolean")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text_col: str = "text",
          id_col: str = "doc_id", steps: int = PIECE_STEPS, with_groups: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row, and the ``groups`` themselves if ``with_groups``.

    A link is a pair of tokens that end together; its count is how many links
    of the corpus hold its id pair. ``n_best`` links have the highest count of
    their B id.
    """
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches):
        task = TaskContext.get().partitionId()
        for n, (ids, block) in enumerate(_blocks(batches, a, b, steps)):
            key = (block.link_a << 32) | block.link_b
            pairs, at, counts = np.unique(key, return_inverse=True, return_counts=True)
            strings = block.group_strings()
            cols = {
                "block": pa.array([(task << 32) | n]), "ids": _one(ids), "pairs": _one(pa.array(pairs)),
                "counts": _one(pa.array(counts.astype(np.int32))),
                "n_a": _one(pa.array(np.diff(block.bounds_a))), "n_b": _one(pa.array(np.diff(block.bounds_b))),
                "n_links": _one(pa.array(np.diff(block.bounds_links))),
                "links": pa.array([pa.compress(at.astype("<u4").tobytes(), "zstd", asbytes=True)], pa.binary()),
                "sha": _one(pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings], pa.string()))}
            if with_groups:
                cols["groups"] = _one(pa.array(strings, pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = (f"block bigint, ids array<{kind}>, pairs array<bigint>, counts array<int>, n_a array<bigint>, n_b array<bigint>, "
              f"n_links array<bigint>, links binary, sha array<string>" + ", groups array<string>" * with_groups)
    blocks = stored(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).mapInArrow(measure, schema), "align-blocks")

    found = (blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
             .select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n")))
    totals = stored(found.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))),
                    "align-totals")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))  # a row for each id of B
    rated = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    back = found.select(F.col("block").alias("home"), "place", "pair").join(rated, "pair").select("home", "place", "total", "best")

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups

    def finish(block: pa.Table, rates: pa.Table) -> pa.Table:
        row = {c: block.column(c).combine_chunks()[0] for c in block.column_names}
        n = np.asarray(row["n_links"].values)
        place = rates.column("place").to_numpy()
        total, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        total[place] = rates.column("total").to_numpy()
        best[place] = rates.column("best").to_numpy()
        size = int(n.sum())
        at = np.frombuffer(pa.decompress(row["links"].as_py(), 4 * size, "zstd", asbytes=True), "<u4") if size else np.zeros(0, np.int64)
        bounds = np.append(0, np.cumsum(n))
        sums = [pa.array(np.diff(np.append(0, np.cumsum(x[at]))[bounds])) for x in (best, total)]
        cols = [row[c].values for c in ("ids", "n_a", "n_b", "n_links", "n_links")] + sums
        cols += [row[c].values for c in ["sha"] + ["groups"] * with_groups]
        return pa.table(cols, names=out)

    result = (f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
              f"groups_sha256 string" + ", groups string" * with_groups)
    return (blocks.drop("pairs", "counts").groupBy("block").cogroup(back.groupBy("home"))
            .applyInArrow(finish, result))


def _one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
