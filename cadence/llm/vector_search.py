"""Exact top-k search by inner product in an M-tree of paged nodes.

Vectors of whole numbers get one more coordinate that brings all to the norm of
the longest (``|x'|**2 = M``), and queries a zero, so that the distance obeys
``|q - x'|**2 = |q|**2 + M - 2 q.x``: the nearest vectors are those of largest
inner product, and a metric tree searches them exactly.

The root's entries are at most ``pivots`` vectors of a bounded sample. Every
vector goes to the entry that is nearest; an entry's vectors stand in pages, by
distance to it (their parent distance), each with a covering radius. Pages are
written once, packed. Hot entries are split over many pages.

Queries go in blocks, pages in groups of bounded bytes. The best-first pass
takes each query to the entry with the smallest possible distance and to a fixed
number of pages there, which bounds its k-th score. The second pass takes it to
each group with a page whose smallest possible distance (distance to the entry,
less the page's reach) does not exceed the bound, and there to each such page.
Within a page, members are skipped without a computation where the triangle
inequality through their stored parent distance rules them out. Scores are
computed as whole numbers; ties go to the smaller id.

A group's pages and then the blocks that ask for it are sent to one task, which
holds the pages and streams the blocks. No join repeats vectors or has them on a
side that Spark may broadcast, as its estimate of packed rows is too low by far;
the driver gets a row for each entry and for each group of pages.

Defined results: null vectors, and those with a null, NaN or infinite component,
take no part; a vector is compared with those of its own length; a repeated row
is a candidate of its own, rows of the query's id are none; a repeated query is
answered once per distinct vector; fewer than k candidates give fewer rows; an
empty table gives an empty result; extra columns are not read. Components up to
2**26 in size are exact in double precision; if any is larger, all arithmetic of
that page is in unbounded integers, and scores outside 64 bits are clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm._tables import discard, ready, shuffle_partitions, stored

PIVOTS, PAGE, QUERIES = 64, 1024, 256
#: Bytes of a group of pages in a worker, at most; groups for each core of the cluster, if they are smaller.
GROUP_BYTES, GROUPS_PER_CORE = 64 << 20, 4
_SINGLE, _SAFE = 1 << 24, 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_TYPES = {2: np.int16, 4: np.float32, 8: np.float64}


def whole_numbers(col, scale: int = 256):
    """floor(scale * x) of each component, null if one is null or not finite."""
    x = F.transform(col, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    ok = F.forall(col, lambda v: F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.when(col.isNotNull() & ok, x)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(len(col), width)


def _pack(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in the smallest type that holds all exactly, and its bytes a number."""
    most = np.abs(x).max(initial=0)
    item = 2 if most < 1 << 15 else 4 if most < _SINGLE else 8
    return x.astype(_TYPES[item]).tobytes(), item


def _unpack(raw: bytes, item: int, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, _TYPES[item]).reshape(rows, width)


def inner(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact whole inner products, in single or double precision where ``most`` (no sum
    of products' sizes is larger) allows it, else clipped to 64 bits."""
    if most < _SAFE:
        kind = np.float32 if most < _SINGLE else np.float64
        return q.astype(kind, copy=False) @ x.astype(kind, copy=False).T
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(big, _LEAST, _MOST).astype(np.int64)


def _reached(scores: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places, row by row, of the scores that are not below their row's least."""
    if scores.dtype != np.int64:  # sizes are below the limit: clipped to it, a least compares as before
        limit = _SINGLE if scores.dtype == np.float32 else _SAFE
        least = np.clip(least, -limit, limit).astype(scores.dtype)
    return np.flatnonzero((scores >= least[:, None]).ravel())


def distances(q: np.ndarray, q_norm: np.ndarray, x: np.ndarray, x_norm: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """Distances between lifted vectors: ``lift`` is the product of the added coordinates."""
    d = q_norm[:, None] + x_norm[None, :] - 2 * (q @ x.T + lift)
    return np.sqrt(np.maximum(d, 0))


class Root:
    """The entries of the root for each vector length, and the longest norm of that length."""

    def __init__(self, entries: dict[int, np.ndarray], longest: dict[int, float]):
        self.entries, self.longest = entries, longest

    def lift(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest[width] - (x * x).sum(axis=1), 0))

    def to_entries(self, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        e = self.entries[x.shape[1]]
        up = self.lift(e, x.shape[1])
        return distances(x, (x * x).sum(axis=1) + added ** 2, e, (e * e).sum(axis=1) + up ** 2, added[:, None] * up[None, :])

    def radius(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance within which the lifted vectors of at least these scores are; infinite for the least score."""
        square = (q * q).sum(axis=1) + self.longest[q.shape[1]]
        # a little more than the distance at the k-th score: rounding must not lose a tie
        r = np.sqrt(np.maximum(square - 2.0 * score, 0) + 1 + 1e-9 * square)
        return np.where(score == _LEAST, np.inf, r)


class Leaf:
    """A page in a worker."""

    def __init__(self, entry: int, ids: np.ndarray, far: np.ndarray, x: np.ndarray):
        self.entry, self.ids, self.far = entry, ids, far
        self.x = x.astype(np.float64 if x.dtype == np.float64 else np.float32)
        self.most = float(np.abs(self.x).max(initial=0))


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, smaller id) of each row, in this order."""
    order = np.lexsort((ids, ~scores, rows))
    rows = rows[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], scores[order[keep]], ids[order[keep]]


def _visit(leaves: list[Leaf], root: Root, q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, score, id): the k best of each query in these pages, of those with its least score."""
    least, last = least.copy(), np.full(len(q), _MOST)
    to_entries, radius = root.to_entries(q, np.zeros(len(q))), root.radius(q, least)
    small = q.astype(np.float32) if (most := float(np.abs(q).max(initial=0))) < _SINGLE else q
    none = np.zeros(0, np.int64)
    held, n = [(none, none, none)], 0
    for leaf in leaves:
        to_entry = to_entries[:, leaf.entry]
        ask = np.flatnonzero((to_entry - radius <= leaf.far[-1]) & (to_entry + radius >= leaf.far[0]))
        if not len(ask):
            continue
        # members whose parent distance no query's ring reaches need no computation
        lo = np.searchsorted(leaf.far, (to_entry - radius)[ask].min(), side="left")
        hi = np.searchsorted(leaf.far, (to_entry + radius)[ask].max(), side="right")
        if lo >= hi:
            continue
        scores = inner(small[ask], leaf.x[lo:hi], most * leaf.most * max(q.shape[1], 1))
        at = _reached(scores, least[ask])
        place, member = np.divmod(at, hi - lo)
        place, s, ids = ask[place], scores.ravel()[at].astype(np.int64), leaf.ids[lo:hi][member]
        ok = (ids != q_ids[place]) & ((s > least[place]) | (ids <= last[place]))
        held.append((place[ok], s[ok], ids[ok]))
        n += len(held[-1][0])
        if n > max(4 * k * len(q), 4096):
            place, s, ids = _best(*map(np.concatenate, zip(*held)), k)
            held, n = [(place, s, ids)], 0
            full = np.flatnonzero(np.append(place[1:] != place[:-1], True) & (np.arange(len(place)) - np.searchsorted(place, place) == k - 1))
            least[place[full]], last[place[full]] = s[full], ids[full]
            radius = root.radius(q, least)
    return _best(*map(np.concatenate, zip(*held)), k)


def _pages(vecs: DataFrame, root: Root, n: int, page: int) -> DataFrame:
    """The leaf pages: ``width, entry, page, low, high`` (reach of parent distances), ``size``, packed members."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.asarray(b.column("width"))
            for w in np.unique(widths):
                part = b.filter(pa.array(widths == w))
                x = _matrix(part.column("v"), int(w))
                d = root.to_entries(x, root.lift(x, int(w)))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("width"), part.column("v"), pa.array(near, pa.int32()),
                     pa.array(d[np.arange(len(near)), near])], names=["vec_id", "width", "v", "entry", "far"])

    placed = stored(vecs.mapInArrow(assign, "vec_id bigint, width int, v array<double>, entry int, far double"), "placed")
    # an entry's share of pages follows its number of rows; there are at most as many rows here as entries
    many = placed.groupBy("width", "entry").agg(F.count(F.lit(1)).alias("n"))
    salted = placed.join(many, ["width", "entry"]).withColumn(
        "salt", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("n") / F.lit(4 * page))).cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, at = 0, None

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            for i in range(0, len(t), page):
                p = t.slice(i, page).combine_chunks()
                far = np.asarray(p["far"], np.float64)
                v, item = _pack(_matrix(p["v"].combine_chunks(), at[0]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([float(far[0])]), pa.array([float(far[-1])]),
                    pa.array([len(p)], pa.int32()), pa.array([np.asarray(p["vec_id"], np.int64).tobytes()], pa.binary()),
                    pa.array([far.tobytes()], pa.binary()), pa.array([v], pa.binary()), pa.array([item], pa.int32())],
                    names=["width", "entry", "low", "high", "size", "ids", "far", "v", "item"])

        for b in batches:
            key = [np.asarray(b.column(c)) for c in ("width", "entry", "salt")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            for i, j in zip(np.append(0, change), np.append(change, b.num_rows)):
                now = tuple(int(k[i]) for k in key)
                if held and now != at:
                    yield from flush()
                    held, rows = [], 0
                at = now
                held.append(b.slice(i, j - i))
                rows += j - i
        if held:
            yield from flush()

    pages = (salted.select("width", "entry", "salt", "far", "vec_id", "v").repartition(n, "width", "entry", "salt")
             .sortWithinPartitions("width", "entry", "salt", "far", "vec_id")
             .mapInArrow(cut, "width int, entry int, low double, high double, size int, ids binary, far binary, v binary, item int"))
    out = stored(pages.withColumn("page", F.monotonically_increasing_id()), "pages")
    discard(placed)
    return out


def _groups(counts: dict[tuple[int, int], int], size: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(first group, number of groups) of each entry's queries or bytes of pages:
    entries with few share a group, those with many have several."""
    out, group, held, width = {}, 0, 0, None
    for (w, e), n in sorted(counts.items()):
        if held and (w != width or held + n > size):
            group, held = group + 1, 0
        width = w
        parts = -(-n // size)
        out[w, e] = (group, parts)
        if parts > 1:
            group, held = group + parts, 0
        else:
            held += n
    return out


def _query_blocks(queries: DataFrame, root: Root, size: int) -> DataFrame:
    """Queries of the same entries packed together: ``block, width, q_ids, q_v, item``."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.asarray(b.column("width"))
            for w in np.unique(widths):
                part = b.filter(pa.array(widths == w))
                x = _matrix(part.column("v"), int(w))
                near = root.to_entries(x, np.zeros(len(x))).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("vec_id", "width", "v")], pa.array(near, pa.int32())],
                                                 names=["vec_id", "width", "v", "entry"])

    placed = stored(queries.mapInArrow(place, "vec_id bigint, width int, v array<double>, entry int"), "queries")
    counts = {(r.width, r.entry): r["count"] for r in placed.groupBy("width", "entry").count().collect()}
    spark = queries.sparkSession
    plan = spark.createDataFrame([(w, e, g, n) for (w, e), (g, n) in _groups(counts, size).items()],
                                 "width int, entry int, first int, parts int")

    def pack(t: pa.Table) -> pa.Table:
        w = t["width"][0].as_py()
        t = t.sort_by([("entry", "ascending"), ("vec_id", "ascending")])
        x = _matrix(t["v"].combine_chunks(), w)
        ids = np.asarray(t["vec_id"], np.int64)
        cut = range(0, len(ids), size)
        packed = [_pack(x[i:i + size]) for i in cut]
        return pa.table({"width": pa.array([w] * len(cut), pa.int32()),
                         "q_ids": pa.array([ids[i:i + size].tobytes() for i in cut], pa.binary()),
                         "q_v": pa.array([v for v, _ in packed], pa.binary()),
                         "item": pa.array([item for _, item in packed], pa.int32())})

    grouped = placed.join(F.broadcast(plan), ["width", "entry"]).withColumn(
        "grp", F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    blocks = grouped.groupBy("grp").applyInArrow(pack, "width int, q_ids binary, q_v binary, item int")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "query-blocks")


def _reach(rows) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each width (group, entry, low, high), by group, from rows of these."""
    out: dict[int, list] = {}
    for width, *r in sorted(rows):
        out.setdefault(width, []).append(r)
    return {w: tuple(np.array(c) for c in zip(*r)) for w, r in out.items()}


def _ask(blocks: DataFrame, root: Root, reach: dict[int, tuple[np.ndarray, ...]]) -> DataFrame:
    """A row for each block and each group that a query of it asks for, with these
    queries. ``reach``: of each width (group, entry, low, high), by group. Without
    bounds each query asks for the group of its nearest entry; with them, for each
    group that can hold a vector within its bound."""
    bounded = "bounds" in blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].as_py()
                w, q_ids = get("width"), np.frombuffer(get("q_ids"), np.int64)
                own = _unpack(get("q_v"), get("item"), len(q_ids), w)
                q = own.astype(np.float64)
                grp, entry, low, high = reach[w]
                d, least = root.to_entries(q, np.zeros(len(q)))[:, entry], np.full(len(q), _LEAST)
                if bounded:
                    for x in get("bounds") or []:
                        least[x["place"]] = x["score"]
                    r = root.radius(q, least)[:, None]
                    hit = (d - r <= high) & (d + r >= low)
                else:
                    hit = d.argmin(axis=1)[:, None] == np.arange(len(entry))
                first = np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))
                hit = np.logical_or.reduceat(hit, first, axis=1)
                ways = [(int(grp[i]), a) for i, a in zip(first, map(np.flatnonzero, hit.T)) if len(a)]
                packed = [_pack(own[a]) for _, a in ways]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g for g, _ in ways], pa.int32()), pa.array([1] * len(ways), pa.int32()), pa.array([w] * len(ways), pa.int32()),
                    pa.array([None] * len(ways), pa.int32()), pa.array([get("block")] * len(ways), pa.int64()),
                    pa.array([item for _, item in packed], pa.int32()),
                    pa.array([q_ids[a].tobytes() for _, a in ways], pa.binary()), pa.array([v for v, _ in packed], pa.binary()),
                    pa.array([None] * len(ways), pa.binary()),
                    pa.array([a.astype(np.int32).tobytes() for _, a in ways], pa.binary()),
                    pa.array([least[a].tobytes() for _, a in ways], pa.binary())], names=list(SENT))

    return blocks.mapInArrow(run, ", ".join(map(" ".join, SENT.items())))


#: What the task of a group gets: its pages (kind 0), then the queries of a block that ask for it (kind 1).
SENT = {"grp": "int", "kind": "int", "width": "int", "entry": "int", "block": "bigint", "item": "int", "ids": "binary", "v": "binary",
        "far": "binary", "places": "binary", "least": "binary"}


def _search(pages: DataFrame, asks: DataFrame, root: Root, k: int, n: int) -> DataFrame:
    """Scores of the queries that ask for a group against its pages (which have its
    number ``grp``), the k best of each query in a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves = None, []
        for b in batches:
            for row in range(b.num_rows):
                get = lambda c: b.column(c)[row].as_py()
                if get("grp") != at:
                    at, leaves = get("grp"), []
                ids = np.frombuffer(get("ids"), np.int64)
                x = _unpack(get("v"), get("item"), len(ids), get("width"))
                if get("kind") == 0:
                    leaves.append(Leaf(get("entry"), ids, np.frombuffer(get("far"), np.float64), x))
                    continue
                place, score, found = _visit(leaves, root, x.astype(np.float64), ids, np.frombuffer(get("least"), np.int64), k)
                yield pa.RecordBatch.from_arrays([
                    pa.array([get("block")] * len(place), pa.int64()), pa.array(np.frombuffer(get("places"), np.int32)[place]),
                    pa.array(ids[place]), pa.array(found), pa.array(score)], names=["block", "place", "query_id", "vec_id", "score"])

    own = pages.withColumns({"kind": F.lit(0)} | {c: F.lit(None).cast(SENT[c]) for c in ("block", "places", "least")})
    return (own.select(*SENT).union(asks).repartitionById(n, "grp").sortWithinPartitions("grp", "kind")
            .mapInArrow(run, "block bigint, place int, query_id bigint, vec_id bigint, score bigint"))


def _k_best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, queries, k: int = 5, scale: int = 256, pivots: int = PIVOTS, page: int = PAGE,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds,
    its k best among all other rows."""
    spark = table.sparkSession
    ready(spark)
    n = shuffle_partitions(spark)
    vecs = table.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"),
                        F.coalesce(queries, F.lit(False)).alias("asks")).filter("v IS NOT NULL AND vec_id IS NOT NULL")
    vecs = stored(vecs.withColumn("width", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = {r.width: r.m for r in vecs.groupBy("width").agg(F.max(norm).alias("m")).collect()}
    # entries: of the vectors in each of ``pivots`` hash slots, the one with the smallest hash
    slot = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(pivots))
    chosen = vecs.groupBy("width", slot.alias("slot")).agg(F.min_by("v", F.xxhash64("v", F.lit(11))).alias("v")).collect()
    mine = {w: [r.v for r in chosen if r.width == w] for w in longest}
    root = Root({w: np.array(v, np.float64).reshape(len(v), w) for w, v in mine.items()}, longest)
    pages = _pages(vecs.select("vec_id", "width", "v"), root, n, page)
    held = sorted(pages.groupBy("width", "entry").agg(F.min("page").alias("seed"), F.sum("size").alias("size")).collect())
    blocks = _query_blocks(vecs.filter("asks").select("vec_id", "width", "v").distinct(), root, QUERIES)
    # a page of each entry is a group of the best-first pass
    first = spark.createDataFrame([(r.seed, i) for i, r in enumerate(held)], "page bigint, grp int")
    seeds = _search(pages.join(F.broadcast(first), "page"), _ask(blocks, root, _reach((r.width, i, r.entry, 0.0, 0.0) for i, r in enumerate(held))),
                    root, k, max(1, min(n, len(held))))
    bounds = (_k_best(seeds, k).filter(F.col("rank") == k).groupBy("block")
              .agg(F.collect_list(F.struct("place", "score")).alias("bounds")))
    taken = {(r.width, r.entry): r.size * (4 * r.width + 16) for r in held}
    most = max((page * (4 * r.width + 16) for r in held), default=1)
    size = max(most, min(GROUP_BYTES, -(-sum(taken.values()) // (GROUPS_PER_CORE * spark.sparkContext.defaultParallelism))))
    parts = _groups(taken, size)
    groups = max((g + m for g, m in parts.values()), default=1)
    plan = spark.createDataFrame([(w, e, g, m) for (w, e), (g, m) in parts.items()], "width int, entry int, first int, parts int")
    pages = pages.join(F.broadcast(plan), ["width", "entry"]).withColumn("grp", (F.col("first") + F.pmod("page", "parts")).cast("int"))
    reach = _reach(tuple(r) for r in pages.groupBy("width", "grp", "entry").agg(F.min("low"), F.max("high")).collect())
    asks = _ask(blocks.join(bounds, "block", "left"), root, reach)
    found = _search(pages, asks, root, k, min(groups, max(n, 2 * -(-sum(taken.values()) // size))))
    return _k_best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
