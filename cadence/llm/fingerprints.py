"""Document fingerprints: invertible Bloom lookup sketches of paragraph pieces.

A text's paragraphs, long ones cut after words whose hash ends in zeros, give
a set of 64-bit piece digests. A sketch adds each digest to one cell in each of
three rows: a count, the sum of the digests and the sum of their check values.
Sketches of two versions subtract cell by cell; equal pieces cancel, and peeling
the cells that hold a single digest recovers which pieces differ and on which
side. If peeling gets stuck, both sketches are built four times larger and
subtracted anew, until it ends. The likeness of two versions is the Jaccard
index of their pieces, which the two set sizes and the number of recovered
digests give exactly.

Sketches of many pairs of texts are built and peeled together.

Defined results: a null text is the empty one; texts without a word have no
pieces; two texts without pieces have likeness 1, one with and one without have
0; repeated pieces of one text count once; a text of any length is sketched
whole. ``with_next`` stands rows in order of descending id, null ids last and
these by their text's hash, rows of one id by hash and text; an only row is its
own next one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bytes import U64, mix, slice_hashes, word_bounds
from cadence.llm._tables import ready, shuffle_partitions

#: Cells of the sketch that the fingerprint shows, and the factor of each retry.
CELLS, GROWTH = 24, 4
#: A paragraph is cut after a word in so many.
PIECE_WORDS = 4
_ROWS = 3
_CHECK = U64(0x6A09E667F3BCC909)


def pieces(data: np.ndarray, offsets: np.ndarray, piece_words: int = PIECE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the distinct pieces of each text, by text."""
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    words = slice_hashes(data, starts, ends)
    lines = np.append(0, np.cumsum(data == 0x0A))
    begin = np.ones(len(starts), bool)
    begin[1:] = (lines[starts[1:]] != lines[ends[:-1]]) | (words[:-1] % U64(piece_words) == 0)
    begin[first[:-1][first[:-1] < len(starts)]] = True
    at = np.flatnonzero(begin)
    digest = slice_hashes(data, starts[at], ends[np.append(at[1:], len(starts)) - 1])
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((digest, owner))
    owner, digest = owner[order], digest[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
    return owner[new], digest[new]


def _cells_of(digest: np.ndarray, cells: int) -> list[np.ndarray]:
    width = cells // _ROWS
    h = [mix(digest + U64(0x9E3779B97F4A7C15 * (cells * _ROWS + j + 1) % (1 << 64))) for j in range(_ROWS)]
    return [(x % U64(width)).astype(np.int64) + j * width for j, x in enumerate(h)]


def sketch(owner: np.ndarray, digest: np.ndarray, sign: np.ndarray | int, n: int, cells: int) -> tuple[np.ndarray, ...]:
    """(counts, digest sums, check sums) of ``n`` sketches, flat; ``sign`` -1 subtracts."""
    count, total, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, U64), np.zeros(n * cells, U64)
    _add(count, total, check, owner, digest, np.broadcast_to(np.asarray(sign, np.int64), digest.shape), cells)
    return count, total, check


def _add(count, total, check, owner, digest, sign, cells) -> None:
    factor = sign.astype(U64)
    value, test = digest * factor, mix(digest ^ _CHECK) * factor
    for c in _cells_of(digest, cells):
        at = owner * cells + c
        np.add.at(count, at, sign)
        np.add.at(total, at, value)
        np.add.at(check, at, test)


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray, n: int, cells: int):
    """Recover what ``n`` differences hold: (owner, digest, sign, whether each ended)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        single = np.flatnonzero(np.abs(count) == 1)
        sign = count[single]
        digest = total[single] * sign.astype(U64)
        real = check[single] * sign.astype(U64) == mix(digest ^ _CHECK)
        owner, digest, sign = single[real] // cells, digest[real], sign[real]
        if not len(owner):
            break
        order = np.lexsort((digest, owner))
        owner, digest, sign = owner[order], digest[order], sign[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])
        owner, digest, sign = owner[new], digest[new], sign[new]
        _add(count, total, check, owner, digest, -sign, cells)
        found.append((owner, digest, sign))
    left = (count != 0) | (total != 0) | (check != 0)
    done = ~left.reshape(n, cells).any(axis=1)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), done
    return *[np.concatenate(x) for x in zip(*found)], done


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS):
    """The differing digests of ``n`` pairs of piece sets: (owner, digest, sign), +1 for ``a``'s own."""
    out = []
    both = [np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]),
            np.concatenate([np.ones(len(a[0]), np.int64), np.full(len(b[0]), -1, np.int64)])]
    # a sketch can't hold more differences than cells, and there are as many at least as the sizes differ by
    least = np.abs(np.bincount(both[0], both[2], n))
    todo = np.arange(n)
    while len(todo):
        now = least[todo] <= cells
        at = np.full(n, -1, np.int64)
        at[todo[now]] = np.arange(now.sum())
        mine = at[both[0]] >= 0
        m = int(now.sum())
        if m:
            owner, digest, sign, done = peel(*sketch(at[both[0][mine]], both[1][mine], both[2][mine], m, cells), m, cells)
            ok = done[owner]
            out.append((todo[now][owner[ok]], digest[ok], sign[ok]))
            todo = np.concatenate([todo[~now], todo[now][~done]])
        cells *= GROWTH
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def likeness(a, b, n: int) -> np.ndarray:
    """Jaccard index of ``n`` pairs of piece sets, from their sizes and differences."""
    differ = np.bincount(differences(a, b, n)[0], minlength=n)
    sizes = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    return np.where(sizes + differ == 0, 1.0, (sizes - differ) / np.maximum(sizes + differ, 1))


def fingerprint_strings(p: tuple[np.ndarray, np.ndarray], n: int) -> list[str]:
    """The number of pieces and the sketch of ``CELLS`` cells, as text."""
    count, total, check = sketch(p[0], p[1], 1, n, CELLS)
    sizes = np.bincount(p[0], minlength=n)
    cell = np.zeros(n * CELLS, [("count", "<i4"), ("digest", "<u8"), ("check", "<u4")])
    cell["count"], cell["digest"], cell["check"] = count, total, (check >> U64(32)).astype(np.uint32)
    raw, size = cell.tobytes(), CELLS * cell.itemsize
    return [f"{sizes[i]}:" + base64.b64encode(raw[i * size:(i + 1) * size]).decode() for i in range(n)]


def _of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw], dtype=np.int64))
    return pieces(np.frombuffer(b"".join(raw), np.uint8), offsets)


def edit(text: str, other: str) -> str:
    """The last half of ``text`` replaced by as much of the beginning of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of descending ids: ``bucket, guest, doc_id, h, t``.

    Cut points are quantiles of the ids. The first row of each range is also a
    guest at the end of the range before it (the first of all at the end of the
    last), so a range holds all successors of its own rows. There are at most a
    few ranges per shuffle partition, and only their first rows' ids are
    gathered. Null ids are dealt by their text's hash after all others.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    ranges = 4 * n
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"))
    cuts = narrow.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    def number(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        at = np.searchsorted(cuts, ids.fill_null(0).to_numpy(), side="right")
        return np.where(known, at, -33 - (hashes.to_numpy() >> 58)).astype(np.int64)

    @F.arrow_udf("long")
    def bucket(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(number(ids, hashes))

    first = narrow.withColumn("bucket", bucket("doc_id", "h")).groupBy("bucket").agg(
        F.min(F.struct((-F.coalesce("doc_id", F.lit(0))).alias("o"), "h", "doc_id")).alias("head")).collect()
    first.sort(key=lambda r: -r.bucket)
    # the row that begins a range -> the range before it
    hosts = {(r.head.doc_id, r.head.h): first[i - 1].bucket for i, r in enumerate(first)}

    @F.arrow_udf("array<struct<bucket:long,guest:boolean>>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for b, i, h in zip(number(ids, hashes).tolist(), ids.to_pylist(), hashes.to_pylist()):
            here = [{"bucket": b, "guest": False}]
            if (i, h) in hosts:
                here.append({"bucket": hosts[i, h], "guest": True})
            out.append(here)
        return pa.array(out, pa.list_(pa.struct([("bucket", pa.int64()), ("guest", pa.bool_())])))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    dealt = rows.select(F.explode(places("doc_id", "h")).alias("p"), "doc_id", "h", "t").select("p.bucket", "p.guest", "doc_id", "h", "t")
    return (dealt.repartition(n, "bucket")
            .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "h", "t"))


def version_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likeness:
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_recovered`` (digests that peeling recovered
    between a text and its edited version)."""
    ready(docs.sparkSession)

    def answer(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        n = len(ids)
        edited = [edit(a, b) for a, b in zip(texts, nexts)]
        p, q, r = _of_texts(texts), _of_texts(edited), _of_texts(nexts)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
            pa.array(fingerprint_strings(p, n), pa.string()), pa.array(fingerprint_strings(q, n), pa.string()),
            pa.array(likeness(p, q, n)), pa.array(likeness(p, r, n)),
            pa.array(np.bincount(differences(p, q, n)[0], minlength=n).astype(np.int64))], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the last own row, whose next one is still to come
        ids, texts, nexts = [], [], []
        for batch in batches:
            for b, guest, i, t in zip(*[batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "t")]):
                if waiting is not None and waiting[0] == b:
                    ids.append(waiting[1])
                    texts.append(waiting[2])
                    nexts.append(t)
                waiting = None if guest else (b, i, t)
                if len(ids) >= block:
                    yield answer(ids, texts, nexts)
                    ids, texts, nexts = [], [], []
        if ids:
            yield answer(ids, texts, nexts)

    return with_next(docs, id_col, text_col).select("bucket", "guest", "doc_id", "t").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, n_recovered long")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_recovered"]
