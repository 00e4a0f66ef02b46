"""Repeated substrings by distributed prefix doubling.

A byte goes if a string of ``threshold`` bytes that covers it also starts in a
document with a smaller id. Positions get ranks by their first ``base`` bytes;
pairs of ranks at growing offsets are sorted and reranked over the corpus until
a position is unique (its string lies in one document) or the ranked length has
reached the threshold. A last sort of pairs finds the smallest document of each
string.

How it is distributed:

* Texts are written once as blocks of whole documents, bucketed by block, so a
  round's answers come back to their block without moving any text again.
* A round's message is what one block has for one range of keys: its distinct
  sorted pairs, delta-coded. A string that a third of all documents repeat is
  one key per block, so it cannot flood a task.
* The answer holds, in the order of the block's keys, the new ranks, 0 for
  positions that are now known to be unique. A block replays the earlier
  answers over its own text, so no table of positions is ever kept.
* ``base`` 25 reaches 50 bytes with one doubling, and costs least; any smaller
  one takes more rounds to the same result.
* Before the first round, two answers leave out what is known to be unique or
  settled. Of equal whole texts all but the first are removed as they are. And
  a window can only be shared if the smallest of its hashed ``threshold // 2``
  grams is (equal windows have equal minima), so windows whose minimum lies in
  one document alone are unique from the start.

Base ranks sort 48-bit hashes of the first ``base`` bytes; all later rounds sort
exact pairs. Two windows could only be confused if one half were equal and the
hashes of the different halves too.

Defined results: null and empty texts have 0 bytes; texts shorter than the
threshold lose nothing; a text of any length is handled whole (one longer than
a block is a block of its own); rows of one id are never compared with each
other, as none is smaller; a null id counts as larger than all others; ids are
integers; an empty table gives an empty result; further columns are carried by
``drop_repeats`` and never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bytes import U64, binary_column, chunks, mix, slice_hashes, window_hashes
from cadence.llm._tables import new_path, ready, shuffle_partitions
from cadence.llm._worker import begin

#: Bytes of text in a block.
BLOCK_BYTES = 2 << 20
#: Bytes of text for which there is a range of keys at least.
RANGE_BYTES = 16 << 20
_NULL_ID = np.iinfo(np.int64).max
_INDEX_BITS = U64(40)
_HALF = U64(32)
_LOW = U64((1 << 32) - 1)


def lengths(base: int, threshold: int) -> list[int]:
    """The ranked lengths: ``base`` doubled up to the threshold."""
    out = [min(base, threshold)]
    while out[-1] < threshold:
        out.append(min(2 * out[-1], threshold))
    return out


# --- messages -------------------------------------------------------------------------------------

def pack(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes, large ones counted from the smallest."""
    a = np.ascontiguousarray(a, U64)
    top = int(a.max()) if len(a) else 0
    low = int(a.min()) if top >> 63 else 0
    if low:
        a = a - U64(low)
    width = ((top - low).bit_length() + 7) // 8
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T
    return (len(a).to_bytes(8, "little") + low.to_bytes(8, "little") + bytes([width])
            + zstandard.ZstdCompressor(level=1).compress(planes.tobytes()))


def unpack(b: bytes) -> np.ndarray:
    n, low, width = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little"), b[16]
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[17:], max_output_size=n * width), np.uint8)
        out[:, :width] = planes.reshape(width, n).T
    out = out.reshape(-1).view(U64)
    return out + U64(low) if low else out


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=U64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U64)


def bucket_of_hash(key: np.ndarray, bits: int, n: int) -> np.ndarray:
    return ((key >> U64(bits - 32)) * U64(n)) >> U64(32)


def bucket_of_rank(rank: np.ndarray) -> np.ndarray:
    return rank >> _INDEX_BITS


# --- one block ------------------------------------------------------------------------------------

def distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, each row's place among them, first row of each,
    whether rows of several owners have it); owners ascend over the rows."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1 if len(s) else first
    o = owner[order]
    return s[new], place, order[first], o[first] != o[last]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``a[i:i + width]``."""
    have = 1
    while 2 * have <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    rest = width - have
    return np.minimum(a[:len(a) - rest], a[rest:]) if rest else a


class Block:
    """One block's positions, replayed through the answers that it has so far."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, base: int, threshold: int):
        self.data, self.offsets, self.ids, self.threshold = data, offsets, ids, threshold
        self.lengths = lengths(base, threshold)
        self.size = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), self.size)

    def digests(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of documents that are long enough, their digest's two parts)."""
        long = np.flatnonzero(self.size >= self.threshold)
        h = b"".join(hashlib.blake2b(self.data[self.offsets[i]:self.offsets[i + 1]], digest_size=16).digest() for i in long)
        h = np.frombuffer(h, U64).reshape(-1, 2)
        return long, h[:, 0] >> U64(16), h[:, 1].copy()

    def windows(self, copies: np.ndarray) -> np.ndarray:
        """Starts of the windows of documents that are no copies."""
        tail = np.minimum(self.size, self.threshold - 1)
        runs = np.stack([self.size - tail, tail], axis=1).reshape(-1)
        flags = np.stack([~copies, np.zeros(len(copies), bool)], axis=1).reshape(-1)
        return np.flatnonzero(np.repeat(flags, runs))

    def minima(self, at: np.ndarray) -> np.ndarray:
        k = max(self.threshold // 2, 1)
        if not len(at):
            return np.zeros(0, U64)
        # minima crowd at small hashes; mixed again they spread over all ranges
        return mix(sliding_min(window_hashes(self.data, k), self.threshold - k + 1)[at]) >> U64(24)

    def needed(self, at: np.ndarray) -> list[np.ndarray]:
        """For each length, the positions whose ranks the windows need."""
        n = len(self.data)
        mask = np.zeros(n, bool)
        mask[at] = True
        out = [mask]
        for short, long in zip(self.lengths[-2::-1], self.lengths[:0:-1]):
            more = mask.copy()
            more[long - short:] |= mask[:n - (long - short)]
            out.append(mask := more)
        return out[::-1]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in an ascending array."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(bucket))):
            yield int(bucket[i]), slice(i, j)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.view(U64) ^ U64(1 << 63)


def _smallest(b: Block, place: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The smallest document id of each distinct key."""
    low = np.full(n, _NULL_ID, np.int64)
    np.minimum.at(low, place, b.ids[owner])
    return low


class Replay:
    """Runs a block's rounds: ``send`` gives the message of round ``r`` after
    the answers of the rounds before, ``removed`` the result after all."""

    def __init__(self, b: Block, buckets: int):
        self.b, self.buckets = b, buckets

    def rounds(self, state: bytes | None = None):
        """A coroutine: yields (bucket, key 1, key 2, extra) of each round and
        is sent that round's answer, aligned with the keys. With the state that
        the first two rounds left, it begins after them."""
        b = self.b
        if state is None:
            # round 0: equal whole texts
            long, h1, h2 = b.digests()
            order = np.lexsort((h2, h1))
            s1, s2 = h1[order], h2[order]
            new = np.ones(len(order), bool)
            new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(new) - 1
            low = _smallest(b, place, long, int(new.sum()))
            earlier = yield bucket_of_hash(s1[new], 48, self.buckets), s1[new], s2[new], _unsigned(low)
            copies = np.zeros(len(b.ids), bool)
            copies[long] = earlier.astype(bool)[place] | (b.ids[long] > low[place])
            # round 1: windows that can be shared
            at = b.windows(copies)
            key, doc = b.minima(at), b.doc[at]
            run = np.ones(len(key), bool)
            run[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            keys, place, _, several = distinct(key[run], doc[run])
            shared = yield bucket_of_hash(keys, 40, self.buckets), keys, None, several.astype(U64)
            at = at[shared.astype(bool)[place][np.cumsum(run) - 1]] if len(at) else at
        else:
            size = int.from_bytes(state[:8], "little")
            copies = np.zeros(len(b.ids), bool)
            copies[unpack_sorted(state[8:8 + size]).astype(np.int64)] = True
            at = _positions(state[8 + size:])
        self.copies = copies
        gone = pack_sorted(np.flatnonzero(copies).astype(U64))
        self.state = len(gone).to_bytes(8, "little") + gone + _stretches(at)
        # base ranks, then pairs of ranks
        need = b.needed(at)
        where = np.flatnonzero(need[0])
        hashes = slice_hashes(b.data, where, where + b.lengths[0]) >> U64(16) if len(where) else np.zeros(0, U64)
        keys, place, _, several = distinct(hashes, b.doc[where])
        last = len(b.lengths) == 1
        extra = _smallest(b, place, b.doc[where], len(keys)) if last else several.astype(U64)
        answer = yield bucket_of_hash(keys, 48, self.buckets), keys, None, _unsigned(extra) if last else extra
        for level in range(1, len(b.lengths)):
            last = level == len(b.lengths) - 1
            off = b.lengths[level] - b.lengths[level - 1]
            local = np.full(len(b.data), -1, np.int32)
            known = answer[place] > 0
            local[where[known]] = place[known]
            where = np.flatnonzero(need[level])
            where = where[(local[where] >= 0) & (local[where + off] >= 0)] if len(where) else where
            code = (local[where].astype(U64) << _HALF) | local[where + off].astype(U64) if len(where) else np.zeros(0, U64)
            ranks = answer
            keys, place, _, several = distinct(code, b.doc[where])
            k1, k2 = ranks[(keys >> _HALF).astype(np.int64)], ranks[(keys & _LOW).astype(np.int64)]
            extra = _smallest(b, place, b.doc[where], len(keys)) if last else several.astype(U64)
            answer = yield bucket_of_rank(k1), k1, k2, _unsigned(extra) if last else extra
        hit = answer.astype(bool)[place] | (b.ids[b.doc[where]] > extra[place]) if len(where) else np.zeros(0, bool)
        self.starts = where[hit]

    def send(self, answers: list[np.ndarray], state: bytes | None = None):
        """The message of the round after ``answers``; None once all are in."""
        co = self.rounds(state)
        try:
            message = next(co)
            for a in answers:
                message = co.send(a)
            return message
        except StopIteration:
            return None

    def removed(self) -> np.ndarray:
        """Whether each byte goes."""
        b = self.b
        edge = np.zeros(len(b.data) + 1, np.int32)
        edge[self.starts] += 1
        edge[self.starts + b.threshold] -= 1
        return (np.cumsum(edge[:-1]) > 0) | np.repeat(self.copies, b.size)


def _stretches(at: np.ndarray) -> bytes:
    """Ascending positions as packed runs."""
    if not len(at):
        return b""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    begin, end = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + 1
    return pack_sorted(np.stack([begin, end], axis=1).reshape(-1).astype(U64))


def _positions(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.int64)
    edges = unpack_sorted(b).astype(np.int64).reshape(-1, 2)
    size = edges[:, 1] - edges[:, 0]
    return np.repeat(edges[:, 0] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


# --- the rounds on Spark --------------------------------------------------------------------------

def _co_located(df: DataFrame, label: str, n: int) -> DataFrame:
    """A table bucketed by ``block``: joins by block move nothing."""
    spark = df.sparkSession
    name = f"llm_{label}_{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd").option("path", new_path(spark, label)).bucketBy(n, "block")
     .saveAsTable(name))
    return spark.table(name)


def _write_blocks(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Blocks: concatenated texts, offsets, ids and the rows' other columns."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.col(text_col).alias("t"), F.col(id_col).cast("long").alias("d"), F.struct(*rest).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix_dedup")
        for batch in batches:
            data, offsets = binary_column(batch.column("t"))
            ids = batch.column("d").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            missing = batch.column("t").is_null().to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets, BLOCK_BYTES):
                sink = pa.BufferOutputStream()
                kept = pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i)], names=["rest"])
                with pa.ipc.new_stream(sink, kept.schema) as w:
                    w.write_batch(kept)
                yield pa.RecordBatch.from_arrays([
                    pa.array([data[offsets[i]:offsets[j]].tobytes()], pa.binary()),
                    pa.array([(offsets[i:j + 1] - offsets[i]).astype(np.int64).tobytes()], pa.binary()),
                    pa.array([ids[i:j].astype(np.int64).tobytes()], pa.binary()),
                    pa.array([missing[i:j].astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["data", "offsets", "ids", "missing", "rest"])

    blocks = src.mapInArrow(run, "data binary, offsets binary, ids binary, missing binary, rest binary")
    return _co_located(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", n)


def _replays(batches: Iterator[pa.RecordBatch], rounds: int, base: int, threshold: int, buckets: int):
    """(column getter, replay, message) of each block."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()
            data = np.frombuffer(get("data"), np.uint8)
            offsets = np.frombuffer(get("offsets"), np.int64)
            ids = np.frombuffer(get("ids"), np.int64)
            answers, state = [], None
            for r in range(2 if rounds > 2 else 0, rounds):
                parts = sorted(get(f"a{r}") or [], key=lambda x: x["bucket"])
                if r == 2:  # the state of the first rounds came along with this answer
                    state = parts.pop(0)["blob"]
                rank = 2 <= r < 1 + len(lengths(base, threshold))
                answers.append(np.concatenate([unpack_answer(x["blob"], x["bucket"], rank) for x in parts]) if parts else np.zeros(0, U64))
            replay = Replay(Block(data, offsets, ids, base, threshold), buckets)
            yield get, replay, replay.send(answers, state)


def _messages(t: DataFrame, rounds: int, base: int, threshold: int, buckets: int) -> DataFrame:
    """What each block has for each range of keys. After the first two rounds
    the block also sends itself its state, under a number below all ranges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffix_dedup")
        for get, replay, (bucket, k1, k2, extra) in _replays(batches, rounds, base, threshold, buckets):
            block, cols = get("block"), [[], [], [], [], []]
            for k, s in _by_bucket(bucket):
                for c, v in zip(cols, (k, block, pack_sorted(k1[s]), None if k2 is None else pack(k2[s]), pack(extra[s].astype(U64)))):
                    c.append(v)
            if rounds == 2:
                for c, v in zip(cols, (-1 - block, block, None, None, replay.state)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[2:]]],
                names=["bucket", "block", "k1", "k2", "extra"])

    return t.mapInArrow(run, "bucket bigint, block bigint, k1 binary, k2 binary, extra binary")


def pack_answer(a: np.ndarray) -> bytes:
    """Which values are set, and the set ones, which ascend with the keys."""
    set_ = a > 0
    bits = pack(np.packbits(set_))
    return len(a).to_bytes(8, "little") + len(bits).to_bytes(8, "little") + bits + pack_sorted(a[set_])


def unpack_answer(blob: bytes, bucket: int, rank: bool) -> np.ndarray:
    """The answers; ranks are numbers within their bucket, whose number goes before them."""
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    set_ = np.unpackbits(unpack(blob[16:16 + size]).astype(np.uint8), count=n).astype(bool)
    out = np.zeros(n, U64)
    values = unpack_sorted(blob[16 + size:])
    out[set_] = values | (U64(bucket) << _INDEX_BITS) if rank else values
    return out


def _answer(kind: str) -> Callable[[pa.Table], pa.Table]:
    """The corpus-wide sort of one range of keys. ``rank``: new ranks of pairs
    that several documents have, 0 for the others; ``shared``: whether several
    have them; ``earlier``: whether a smaller id than the block's own has it."""
    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return pa.table({"block": t["block"], "bucket": t["bucket"], "blob": t["extra"]})
        k1s = [unpack_sorted(x.as_py()) for x in t["k1"]]
        extra = np.concatenate([unpack(x.as_py()) for x in t["extra"]])
        k1 = np.concatenate(k1s)
        paired = t["k2"][0].as_py() is not None
        if paired:
            k2 = np.concatenate([unpack(x.as_py()) for x in t["k2"]])
            order = np.lexsort((k2, k1))
        else:
            order = np.argsort(k1, kind="stable")
        s1 = k1[order]
        new = np.ones(len(s1), bool)
        new[1:] = s1[1:] != s1[:-1]
        if paired:
            s2 = k2[order]
            new[1:] |= s2[1:] != s2[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        sorted_extra = extra[order]
        if kind == "earlier":
            value = (np.minimum.reduceat(sorted_extra, first)[group] < sorted_extra).astype(U64)
        else:
            shared = (np.diff(np.append(first, len(s1))) > 1) | (np.maximum.reduceat(sorted_extra, first) > 0)
            value = (np.cumsum(shared) * shared if kind == "rank" else shared).astype(U64)[group]
        out = np.empty(len(order), U64)
        out[order] = value
        cuts = np.cumsum([len(k) for k in k1s])[:-1]
        return pa.table({"block": t["block"], "bucket": t["bucket"],
                         "blob": pa.array([pack_answer(a) for a in np.split(out, cuts)], pa.binary())})

    return run


def _rounds(docs: DataFrame, threshold: int, base: int, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    spark = docs.sparkSession
    ready(spark)
    n = shuffle_partitions(spark)
    t = _write_blocks(docs, id_col, text_col, n)
    buckets = max(2 * n, t.select("block").count() * BLOCK_BYTES // RANGE_BYTES)
    kinds = ["earlier", "shared", *["rank"] * (len(lengths(base, threshold)) - 1), "earlier"]
    for r, kind in enumerate(kinds):
        sent = _messages(t, r, base, threshold, buckets)
        if buckets > 2 * n:  # more ranges, so more tasks
            sent = sent.repartition(buckets // 2, "bucket")
        answers = (sent.groupBy("bucket")
                   .applyInArrow(_answer(kind), "block bigint, bucket bigint, blob binary")
                   .groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias(f"a{r}")))
        t = t.join(_co_located(answers, f"answers{r}", n), "block", "left")
        if r == 2:
            t = t.drop("a0", "a1")
    return t, len(kinds), buckets


def repeated_spans(docs: DataFrame, threshold: int = 50, base: int = 25, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    t, rounds, buckets = _rounds(docs, threshold, base, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, replay, _ in _replays(batches, rounds, base, threshold, buckets):
            b, gone = replay.b, replay.removed()
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            begin = b.offsets[:-1][np.diff(b.offsets) > 0]
            starts[begin] = gone[begin]
            count = lambda m: np.diff(np.append(0, np.cumsum(m))[b.offsets])
            sums = [hashlib.sha256(b.data[i:j][~gone[i:j]]).hexdigest() for i, j in zip(b.offsets[:-1], b.offsets[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(b.ids, pa.int64(), mask=b.ids == _NULL_ID), pa.array(np.diff(b.offsets), pa.int64()),
                pa.array(count(gone), pa.int64()), pa.array(count(starts), pa.int64()), pa.array(sums, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return t.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def drop_repeats(docs: DataFrame, threshold: int = 50, base: int = 25, id_col: str = "doc_id", text_col: str = "text",
                 chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text, and ``chars_col``
    counted anew. Where a cut leaves part of a character, that part goes too;
    a null text stays null."""
    t, rounds, buckets = _rounds(docs, threshold, base, id_col, text_col)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    names = [text_col, *[f.name for f in rest]]
    recount = chars_col if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for get, replay, _ in _replays(batches, rounds, base, threshold, buckets):
            b, gone = replay.b, replay.removed()
            missing = np.frombuffer(get("missing"), np.uint8)
            texts = [None if m else b.data[i:j][~gone[i:j]].tobytes().decode("utf-8", "ignore")
                     for m, i, j in zip(missing, b.offsets[:-1], b.offsets[1:])]
            other = pa.ipc.open_stream(get("rest")).read_all().column("rest").combine_chunks()
            cols = {text_col: pa.array(texts, pa.string())} | dict(zip([f.name for f in rest], other.flatten()))
            if recount:
                cols[recount] = pa.array([None if x is None else len(x) for x in texts], cols[recount].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    schema = docs.select(*names).schema
    return t.mapInArrow(run, schema).select(*docs.columns)
