"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

A document's set holds the 64-bit hashes of its distinct word shingles. A
first permutation scatters the hashes over 2**32 places; a second one, shifted
circularly by k places, gives signature coordinate k as its minimum over the
set, so two permutations make all coordinates. Bands of equal coordinates
propose candidates, and a link holds only if the full sets meet the threshold.

No bucket is expanded into all its pairs. Equal sets form one class first. In
each bucket every class is verified against the bucket's class with the smallest
id; most of a group of near copies is then one component. Classes of one bucket
that are still in different components must not miss a link either. They are
joined on rare shingles: shingles that only one component has come first, then
by rising frequency, so that of two sets that meet the threshold the first
common shingle lies among the first fifth of both, and what can still follow it
must suffice. A class whose own component alone has a fifth of its shingles
meets nobody; no pair within a component is ever formed.

Defined results: null and empty texts, and texts without words, have an empty
set and link with nothing; with fewer words than a shingle the whole sequence
is the one shingle; equal texts link; rows that share a ``doc_id`` and a text
are one document; a null ``doc_id`` is never the smallest of a component that
has another; an empty table gives an empty result; extra columns are not read.
Sets and signatures are built from whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._bytes import LOWER, U64, binary_column, chunks, mix, slice_hashes, word_bounds
from cadence.llm._tables import discard, ready, stored
from cadence.llm._worker import begin
from cadence.llm.components import components

#: 32 bands of 4 coordinates: a pair at similarity 0.8 shares no band with probability 5e-8.
BANDS, ROWS = 32, 4
_SET_BYTES = 8


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = slice_hashes(data, starts, ends)
    out = []
    if len(words) >= k:
        n = len(words) - k + 1
        rolled = words[:n].copy()
        for j in range(1, k):
            rolled = mix(rolled + words[j:j + n] * U64(2 * j + 1))
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= k:
            out.append(np.unique(rolled[a:b - k + 1]))
        elif b > a:
            h = mix(np.array([b - a], U64) ^ U64(0x5851F42D4C957F2D))
            for w in range(a, b):
                h = mix(h + words[w:w + 1] * U64(3))
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit places, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set: ``size`` coordinates from two permutations."""
    places = (mix(s ^ U64(0x2545F4914F6CDD1D)) >> U64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)
    low = None
    for at in range(0, len(places), 2048):
        block = _permute(places[at:at + 2048, None] + shifts).min(axis=0)
        low = block if low is None else np.minimum(low, block)
    return low


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(bands, -1).astype(U64)
    h = mix(np.arange(1, bands + 1, dtype=U64) << U64(32))
    for j in range(rows.shape[1]):
        h = mix(h + rows[:, j] * U64(2 * j + 3))
    return h.view(np.int64)


def _signatures(texts: DataFrame, k: int, bands: int, rows: int, id_type: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        for batch in batches:
            data, offsets = binary_column(batch.column("t"))
            for i, j in chunks(offsets):
                part = offsets[i:j + 1] - offsets[i]
                sets = shingle_sets(data[offsets[i]:offsets[j]], part, k)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), batch.column("text_hash").slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_keys(signature(s, bands * rows), bands) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "bands"])

    return texts.select("doc_id", "text_hash", "t").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(node, t) -> (node, s): the set as packed hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("near_dedup")
        for batch in batches:
            data, offsets = binary_column(batch.column("t"))
            for i, j in chunks(offsets):
                part = offsets[i:j + 1] - offsets[i]
                sets = shingle_sets(data[offsets[i]:offsets[j]], part, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "s"])

    return texts.select("node", "t").mapInArrow(run, "node bigint, s binary")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(node, s, label) -> the pairs (a, b) of different labels that can meet the threshold."""
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, s, label in zip(*[batch.column(c) for c in ("node", "s", "label")]):
                x = np.frombuffer(s.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(x), node.as_py())), pa.array(np.full(len(x), label.as_py())), pa.array(x)],
                    names=["node", "label", "token"])

    def prefix(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["token"], t["often"], np.asarray(t["alone"]) == 0))
        n = len(order)
        reach = n - -(-percent * n // 100) + 1
        place = np.arange(n, dtype=np.int32)
        keep = np.flatnonzero((np.asarray(t["alone"])[order] == 0) & (place < reach))
        return pa.table({"node": t["node"].take(order[keep]), "label": t["label"].take(order[keep]),
                         "token": t["token"].take(order[keep]), "place": pa.array(place[keep]),
                         "n": pa.array(np.full(len(keep), n, np.int32))})

    tokens = stored(sets.select("node", "s", "label").mapInArrow(shingles, "node bigint, label bigint, token bigint"), "tokens")
    counts = stored(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("lo"), F.max("label").alias("hi"))
                    .select("token", "often", (F.col("lo") == F.col("hi")).cast("int").alias("alone")), "token-counts")
    first = stored(tokens.join(counts, "token").groupBy("node").applyInArrow(
        prefix, "node bigint, label bigint, token bigint, place int, n int"), "prefixes")
    discard(tokens, counts)
    x, y = first.alias("x"), first.alias("y")
    # 100 * both >= percent * union, so both >= percent * (n + n) / (100 + percent)
    can = (f"x.token = y.token AND x.node > y.node AND x.label != y.label "
           f"AND least(x.n - x.place, y.n - y.place) * {100 + percent} >= {percent} * (x.n + y.n)")
    return x.join(y, F.expr(can)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text", one_row: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``, and ``text_hash`` to tell rows of one id apart."""
    spark = docs.sparkSession
    ready(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    sig = stored(_signatures(texts, shingle_words, bands, rows, id_type)
                 .withColumn("row", F.monotonically_increasing_id()), "signatures")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row"))
    classes = stored(sig.filter("digest IS NOT NULL").groupBy("digest").agg(
        first_row.alias("first"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
        .select(F.xxhash64("digest").alias("node"), "digest", F.col("first.doc_id").alias("first_id"), "first", "bands", "n"), "classes")
    exploded = classes.select("node", "first_id", F.explode("bands").alias("key"))
    buckets = stored(exploded.groupBy("key").agg(F.min(F.struct("first_id", "node")).alias("l"), F.min("node").alias("lo"),
                                                 F.max("node").alias("hi"))
                     .filter("lo != hi").select("key", F.col("l.node").alias("leader")), "buckets")
    members = stored(exploded.join(buckets, "key").select("key", "node", "leader"), "members")
    # the text of one row of each class that shares a bucket
    wanted = members.select("node").distinct().join(classes.select("node", "digest"), "node")
    holders = (sig.select("digest", "doc_id", "text_hash").join(wanted, "digest").groupBy("node")
               .agg(F.min(F.struct("doc_id", "text_hash")).alias("h")).select("node", "h.doc_id", "h.text_hash"))
    held = texts.join(holders, texts.doc_id.eqNullSafe(holders.doc_id) & (texts.text_hash == holders.text_hash))
    # repeated rows of a holder are one node
    sets = stored(_sets(held.groupBy("node").agg(F.min("t").alias("t")), shingle_words), "sets")
    stars = members.filter("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    stars = stored(stars, "stars")
    links = stored(_links(stars, sets, percent), "links")
    labels = components(links)
    # classes of one bucket in different components
    placed = stored(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "placed")
    keys = stored(placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                  .filter("lo != hi").select("key"), "open-keys")
    open_ = placed.join(keys, "key").select("node", "label").distinct()
    across = stored(_rare_pairs(sets.join(open_, "node"), percent), "across")
    more = stored(_links(across, sets, percent), "more-links")
    if more.limit(1).count():
        labels = components(links.union(more))
    named = (classes.select("node", "digest", "first").join(labels, "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    smallest = named.groupBy("label").agg(F.min("first").alias("first"))
    answer = stored(named.drop("first").join(smallest, "label").select(
        "digest", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first_row")), "answer")
    discard(members, sets, placed, keys, buckets, across)
    out = sig.select("doc_id", "text_hash", "n_shingles", "digest", "row").join(answer, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    if one_row:
        wordless = sig.filter("digest IS NULL").groupBy("doc_id", "text_hash").agg(F.min("row").alias("row"))
        out = out.join(wordless.select("row", F.lit(True).alias("lone")), "row", "left")
        kept = F.coalesce(F.col("row") == F.col("first_row"), F.col("lone"), F.lit(False))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group, with ``one_row`` in one row."""
    found = near_duplicates(docs, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    both = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    rows = keyed.join(keep, both, "left_semi")
    if options.get("one_row"):
        # of rows with one id and text the one whose other columns come first
        rest = F.to_json(F.struct(F.lit(1).alias("_"), *[F.col("row")[c].alias(c) for c in docs.columns if c not in (id_col, text_col)]))
        rows = rows.groupBy("id", "hash").agg(F.min_by("row", rest).alias("row"))
    return rows.select("row.*")
