"""Quality scores by nearest-neighbour voting among latent-semantic vectors.

A text is a vector of hashed counts in three families of equal length: byte
trigrams, trigrams of character-class runs (its shape), and how its words
repeat. ``fit`` takes a bounded sample of labelled texts, finds the
``DIMENSIONS`` strongest directions of their vectors by a singular value
decomposition, and keeps the sampled texts' unit vectors in that space. Every
document is projected alike and compared with all of them, in blocks, by exact
cosine products; its ``NEIGHBOURS`` nearest vote with their similarity, and a
label's votes are weighed by how much of it was sampled.

The sample holds, of each label, the ``SAMPLE`` distinct texts with the
smallest digests, or all. The model is that many vectors of ``DIMENSIONS``
numbers and the projection, about 3 MB whatever the input, and is broadcast.

Defined results: null and empty texts (and texts without any feature) score the
share of label 1 among what may be learned; if nothing may be learned, every
score is 0.5. Conflicting labels of a document count by their majority, ties as
label 1; null labels and labels without a document are left out. Repeated rows
and null ids are scored like others; texts of any length are read whole, in
slices; extra columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._bytes import CHUNK_BYTES, SPACE, U64, binary_column, chunks, mix, slice_hashes, word_bounds
from cadence.llm._tables import discard, ready, stored
from cadence.llm._worker import begin

#: Sampled texts of a label, directions kept, voting neighbours.
SAMPLE, DIMENSIONS, NEIGHBOURS = 3000, 64, 15
#: Hashed features: byte trigrams, shapes, and repetition (told from each other by their place).
TRIGRAMS, SHAPES, REPEATS = 4096, 512, 16
WIDTH = TRIGRAMS + SHAPES + REPEATS
#: Rows of a block, for products and dense counts.
ROWS = 512

# classes of bytes: letters, capitals, digits, spaces, line ends, other marks, bytes of longer characters
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 0
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("0"):ord("9") + 1] = 2
_CLASS[SPACE] = 3
_CLASS[[10, 13]] = 4
_CLASS[128:] = 6


class _Counts:
    """Counts of a block's texts, to which slices of them are added."""

    def __init__(self, rows: int):
        self.rows = rows
        self.grams = np.zeros((rows, TRIGRAMS), np.float32)
        self.shapes = np.zeros((rows, SHAPES), np.float32)
        self.words, self.again = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n, rows = len(data), self.rows
        if n == 0:
            return
        row = np.repeat(np.arange(rows), np.diff(offsets))
        wide = data.astype(U64)
        if n > 2:
            code = (mix((wide[:-2] << U64(16)) | (wide[1:-1] << U64(8)) | wide[2:]) % U64(TRIGRAMS)).astype(np.int64)
            inside = row[:-2] == row[2:]
            self.grams += np.bincount((row[:-2] * TRIGRAMS + code)[inside], minlength=rows * TRIGRAMS).reshape(rows, -1)
        kind = _CLASS[data]
        begins = np.ones(n, bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(begins)
        length = np.minimum(np.diff(np.append(at, n)), 3)
        run = (kind[at].astype(np.int64) * 4 + length).astype(U64)
        run_row = row[at]
        if len(run) > 2:
            code = (mix((run[:-2] << U64(10)) | (run[1:-1] << U64(5)) | run[2:]) % U64(SHAPES)).astype(np.int64)
            inside = run_row[:-2] == run_row[2:]
            self.shapes += np.bincount((run_row[:-2] * SHAPES + code)[inside], minlength=rows * SHAPES).reshape(rows, -1)
        starts, ends, first = word_bounds(data, offsets)
        if len(starts):
            word = slice_hashes(data, starts, ends)
            owner = np.repeat(np.arange(rows), np.diff(first))
            self.words += np.diff(first)
            same = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
            self.again += np.bincount(owner[1:][same], minlength=rows)
            self.seen.append(self._distinct(owner, word))

    def _distinct(self, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((word, owner))
        owner, word = owner[order], word[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])
        return owner[new], word[new]

    def vectors(self) -> np.ndarray:
        """Feature vectors: dampened counts, each family of length one (or zero)."""
        distinct = np.zeros(self.rows, np.int64)
        if self.seen:
            owner, word = (np.concatenate(x) for x in zip(*self.seen))
            distinct = np.bincount(self._distinct(owner, word)[0], minlength=self.rows)
        some = np.maximum(self.words, 1)
        repeats = np.zeros((self.rows, REPEATS), np.float32)
        # shares fall between two of eight steps: of distinct words (longer texts have fewer), of words said twice
        for k, share in ((0, np.log1p(distinct) / np.log1p(some)), (8, self.again / some)):
            place = np.clip(share, 0, 1) * 6.999
            low = place.astype(np.int64)
            repeats[np.arange(self.rows), k + low] = 1 - (place - low)
            repeats[np.arange(self.rows), k + np.minimum(low + 1, 7)] += place - low
        repeats[self.words == 0] = 0
        return np.concatenate([_unit(np.log1p(self.grams)), _unit(np.log1p(self.shapes)), _unit(repeats)], axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of one long text, cut behind white space where there is any."""
    at = 0
    while at < len(data):
        to = min(at + CHUNK_BYTES, len(data))
        if to < len(data):
            gaps = np.flatnonzero(SPACE[data[at + 1:to]])
            to = at + 2 + int(gaps[-1]) if len(gaps) else to
        yield data[at:to]
        at = to


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Feature vectors of texts, in blocks of rows."""
    data, offsets = binary_column(column)
    for i, j in chunks(offsets):
        for k in range(i, j, ROWS):
            m = min(k + ROWS, j)
            counts = _Counts(m - k)
            part = data[offsets[k]:offsets[m]]
            if len(part) <= CHUNK_BYTES:
                counts.add(part, offsets[k:m + 1] - offsets[k])
            else:
                for piece in _slices(part):
                    counts.add(piece, np.array([0, len(piece)]))
            yield counts.vectors()


class Model(NamedTuple):
    """``projection`` (features, directions), unit ``vectors`` and ``votes`` (label, weight) of the sample, the ``prior`` of label 1."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of feature vectors, by exact products with all sampled vectors."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        like = _unit(x @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, like.shape[1])
        near = np.argpartition(-like, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(like, near, 1), 0) * self.weights[near]
        total = vote.sum(1)
        good = (vote * self.labels[near]).sum(1)
        return np.where(total > 0, good / np.where(total > 0, total, 1), self.prior).clip(0, 1)


def _decompose(sample: pa.Table) -> pa.Table:
    """The strongest directions of the sampled feature vectors and the vectors along them."""
    order = np.lexsort([sample.column(c).to_numpy(zero_copy_only=False) for c in ("label", "digest")])
    x = np.frombuffer(b"".join(sample.column("features").take(pa.array(order)).to_pylist()), "<f4").reshape(len(order), WIDTH)
    k = min(DIMENSIONS, *x.shape)
    # power iterations on a random start: the leading right singular vectors
    q = np.linalg.qr(x.T @ np.random.default_rng(13).standard_normal((len(x), k + 16)).astype("f4"))[0]
    for _ in range(6):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ v[:k].T).astype("<f4")
    return pa.table({"projection": [projection.tobytes()], "vectors": [_unit(x @ projection).astype("<f4").tobytes()],
                     "labels": [sample.column("label").take(pa.array(order)).to_pylist()]},
                    schema=pa.schema([("projection", pa.binary()), ("vectors", pa.binary()), ("labels", pa.list_(pa.int32()))]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", text_col: str = "text",
        id_col: str = "doc_id") -> Model:
    """A model from the labelled documents for which ``learn`` holds."""
    spark = docs.sparkSession
    ready(spark)
    known = (labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("double").alias("y")).filter("key is not null and y is not null")
             .groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("label")))
    content = F.coalesce(F.col(text_col), F.lit(""))
    rows = (docs.filter(learn).select(F.col(id_col).alias("key"), F.sha2(content.cast("binary"), 256).alias("digest"))
            .join(known, "key").select("label", "digest"))
    # a text that stands under both labels votes for each
    texts = stored(rows.groupBy("label", "digest").agg(F.count(F.lit(1)).alias("n")), "quality-texts")
    sums = {r.label: (r.texts, r.n) for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).collect()}
    total = sum(n for _, n in sums.values())
    if not total:
        return Model(np.zeros((WIDTH, 0), "f4"), np.zeros((0, 0), "f4"), np.zeros(0), np.zeros(0), 0.5)
    picked = [texts.filter(F.col("label") == c).select("label", "digest").orderBy("digest").limit(SAMPLE) for c in sorted(sums)]
    sample = picked[0].union(picked[1]) if len(picked) == 2 else picked[0]
    # at most 2 * SAMPLE rows, so broadcast; one copy of each text gives its features
    wanted = F.broadcast(sample.select("digest").distinct())

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("quality")
        for b in batches:
            at = 0
            for x in features(b.column("content")):
                yield pa.RecordBatch.from_arrays([b.column("digest").slice(at, len(x)),
                                                  pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())],
                                                 names=["digest", "features"])
                at += len(x)

    found = (docs.filter(learn).select(F.sha2(content.cast("binary"), 256).alias("digest"), content.alias("content"))
             .join(wanted, "digest").mapInArrow(vectors, "digest string, features binary")
             .groupBy("digest").agg(F.first("features").alias("features")))
    made = (found.join(F.broadcast(sample), "digest").groupBy(F.lit(0).alias("all"))
            .applyInArrow(_decompose, "projection binary, vectors binary, labels array<int>").collect()[0])
    discard(texts)
    y = np.array(made["labels"], np.float64)
    share = {c: (n / total) / min(t, SAMPLE) for c, (t, n) in sums.items()}
    return Model(np.frombuffer(made["projection"], "<f4").reshape(WIDTH, -1),
                 np.frombuffer(made["vectors"], "<f4").reshape(len(y), -1), y,
                 np.array([share[int(c)] for c in y]), sums.get(1, (0, 0))[1] / total)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``score``: how likely label 1 is, 0 to 1."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("quality")
        m = shared.value
        for column in batches:
            empty = np.asarray(binary_column(column)[1])
            out = [m.score(x) for x in features(column)]
            found = np.concatenate(out) if out else np.zeros(0)
            found[np.diff(empty) == 0] = m.prior
            yield pa.array(found, pa.float64())

    return docs.withColumn("score", scores(F.col(text_col)))


def held_out(id_col: str = "doc_id", mod: int = 5) -> Column:
    """Whether a document is held out of learning (null ids are)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == 0, F.lit(True))
