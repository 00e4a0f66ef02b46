"""Trie of conversation prefixes by a splitter skeleton.

A conversation is its path: a digest of role and text for each turn. Paths
are dealt to shards by ranges whose splitters come from a bounded sample. A
node whose members lie in more than one shard is a prefix of a splitter, so
the trie of the splitter paths (the skeleton, of at most shards times
``SPLITTER_TURNS`` nodes) is broadcast: each shard sorts its paths, finishes
all nodes outside the skeleton in one pass that holds one path at a time, and
gives partial aggregates for the skeleton's nodes, which a reduction adds up.

Equal paths are dealt by their conversation's id, so a path that very many
conversations share is spread over shards too (one of more than
``SPLITTER_TURNS`` turns is not, as splitters are cut there: its shard takes
longer, and holds no more). The ids that end at a skeleton node are digested
from runs of up to ``RUN`` ids, in order, by a task that streams them.

Defined results: null roles and texts are empty; turns go by number, null
first, equal numbers by the digest of their role and text; repeated rows are
turns of their own; rows without ``conv_id`` belong to no conversation and are
left out; a conversation without a turn is a member of the root; an empty
table has no node; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm._tables import ready, shuffle_partitions, stored

#: Turns of a splitter, sampled paths for each shard, ids of a run.
SPLITTER_TURNS = 256
SAMPLE = 40
RUN = 4096

Key = tuple[bytes, int]


def conversation_paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path``: for each conversation its turns in order, as
    (digest of role and text, code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    step = F.struct(F.col("turn").alias("turn"), digest.alias("d"), F.length(text).alias("n"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), step.alias("s"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("path")).select(
        "conv_id", F.transform("path", lambda s: F.struct(s.d.alias("d"), s.n.alias("n"))).alias("path"))


def crc_mod(col: Column, mod: int) -> Column:
    return (F.crc32(col.cast("string").cast("binary")) % mod).cast("int")


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first of their hundred."""
    h = crc_mod(F.col("conv_id"), 6)
    own = paths.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), "path")
    base = paths.select(F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("first")).filter(F.col("base") % 100 == 0)
    first = F.slice(F.coalesce("first", F.array().cast(paths.schema["path"].dataType)), F.lit(1), F.col("h"))
    rest = F.filter("path", lambda x, i: i >= F.col("h"))
    return own.join(base, "base", "left").select("conv_id", F.concat(first, rest).alias("path"))


class Skeleton:
    """The trie of the splitter paths: node 0 is the root, numbered so that a
    parent comes before its children."""

    def __init__(self, splitters: list[Key]):
        self.splitters = splitters
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), 16):
                step = path[at:at + 16]
                if step not in self.children[node]:
                    self.children[node][step] = len(self.children)
                    self.children.append({})
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.children[node][step]


def splitters(paths: DataFrame, shards: int) -> list[Key]:
    """At most ``shards - 1`` (path, conv_id) that cut the sorted paths into
    about even ranges, from a sample of ``SAMPLE`` times as many of them. A path
    that is cut at ``SPLITTER_TURNS`` stands before all that go on from it."""
    key = F.array_join(F.transform(F.slice("path", 1, SPLITTER_TURNS), lambda s: F.hex(s.d)), "")
    sample = (paths.orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLE)
              .select(key.alias("key"), "conv_id").collect())
    rows = sorted((bytes.fromhex(r.key), r.conv_id) for r in sample)
    found = {rows[len(rows) * i // shards] for i in range(1, shards)} if rows else set()
    return sorted({(k, i if len(k) < 16 * SPLITTER_TURNS else -(1 << 63)) for k, i in found})


#: Nodes are numbered: those of the skeleton by the skeleton, others by their shard's task.
_SHARD = ("kind int, node bigint, parent bigint, conv_id bigint, depth int, n_convs bigint, n_children bigint, "
          "n_leaves bigint, saved_tokens bigint, chars int, ends string")


class _Node:
    """An open node of the path that a shard has reached."""

    __slots__ = ("conv_id", "n_convs", "children", "leaves", "saved", "chars", "skeleton", "number", "ends")

    def __init__(self, conv_id: int, chars: int, skeleton: int, number: int):
        self.conv_id, self.chars, self.skeleton, self.number = conv_id, chars, skeleton, number
        self.n_convs = self.children = self.leaves = self.saved = 0
        self.ends = None  # digest of the ids that end here, or the ids of an open run


def walk_shards(rows: Iterator[tuple[int, int, list[bytes], list[int]]], skeleton: Skeleton, task: int = 0) -> Iterator[tuple]:
    """Nodes of a task's shards, whose (shard, conv_id, steps, code points) are
    sorted: finished ones (kind 0; 3 below a skeleton node), partial aggregates
    of skeleton nodes (1) and runs of ids that end at them (2)."""
    stack: list[_Node] = []
    path: list[bytes] = []
    numbers = count(task << 40)

    def run(node: _Node, depth: int) -> tuple:
        row = (2, node.skeleton, None, node.ends[0], depth, 0, 0, 0, 0, 0, ",".join(map(str, node.ends)))
        node.ends = []
        return row

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            d = len(stack)
            above = stack[-1] if stack else None
            if node.skeleton >= 0:
                if node.ends:
                    yield run(node, d)
                yield (1, node.skeleton, skeleton.parent[node.skeleton], node.conv_id, d, node.n_convs, node.children,
                       node.leaves, node.saved, node.chars, None)
                continue
            leaves = node.leaves if node.children else 1
            saved = node.saved + (node.n_convs - 1) * node.chars
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            below = above.skeleton >= 0
            yield (3 if below else 0, node.number, above.skeleton if below else above.number, node.conv_id, d, node.n_convs,
                   node.children, leaves, saved, None, (node.ends or hashlib.sha256()).hexdigest())

    at = None
    for shard, conv_id, steps, chars in rows:
        if shard != at:  # other shards may lie between two of a task
            yield from close(0)
            at, path = shard, []
            stack.append(_Node(conv_id, 0, 0, 0))
        same = 0
        for x, y in zip(path, steps):
            if x != y:
                break
            same += 1
        yield from close(same + 1)
        for k in range(same, len(steps)):
            s = stack[-1].skeleton
            stack.append(_Node(conv_id, chars[k], skeleton.children[s].get(steps[k], -1) if s >= 0 else -1, next(numbers)))
        path = steps
        for node in stack:
            node.n_convs += 1
            if conv_id < node.conv_id:
                node.conv_id = conv_id
        last = stack[-1]
        if last.skeleton >= 0:
            last.ends = last.ends or []
            last.ends.append(conv_id)
            if len(last.ends) >= RUN:
                yield run(last, len(stack) - 1)
        elif last.ends is None:
            last.ends = hashlib.sha256(str(conv_id).encode())
        else:
            last.ends.update(b",%d" % conv_id)
    yield from close(0)


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the runs of each node, which come in order."""
    at, digest = None, None
    for batch in batches:
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if node == at:
                digest.update(b",")
            else:
                if at is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "sha"])
                at, digest = node, hashlib.sha256()
            digest.update(text.encode())
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["node", "sha"])


def _finish_skeleton(nodes: pa.Table) -> pa.Table:
    """Subtree sums of the skeleton's nodes, whose own sums are whole: children
    have larger numbers than their parent, so one walk downwards adds them up."""
    rows = {r["node"]: r for r in nodes.to_pylist()}
    for n in sorted(rows, reverse=True):
        r = rows[n]
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"] if r["depth"] else 0
        above = rows.get(r["parent"])
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += r["n_leaves"]
            above["saved_tokens"] += r["saved_tokens"]
    for r in rows.values():
        r["parent_conv_id"] = rows[r["parent"]]["conv_id"] if r["parent"] in rows else None
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array([r[c] for r in rows.values()], k) for c, k in zip(names, kinds)], names=names)


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256`` of every node of the trie of ``paths``
    (``conv_id``, distinct, and ``path`` as ``conversation_paths`` gives it).

    A node is named by its smallest member and its depth. ``saved_tokens`` is
    what its subtree saves if each node's last text is kept once.
    """
    spark = paths.sparkSession
    ready(spark)
    shards = shards or 2 * shuffle_partitions(spark)
    paths = stored(paths.select("conv_id", "path"), "trie-paths")
    skeleton = spark.sparkContext.broadcast(Skeleton(splitters(paths, shards)))

    @F.arrow_udf("int")
    def shard_of(key: pa.Array, conv_id: pa.Array) -> pa.Array:
        cuts = skeleton.value.splitters
        return pa.array([bisect_right(cuts, (k, i)) for k, i in zip(key.to_pylist(), conv_id.to_pylist())], pa.int32())

    steps = F.transform("path", lambda s: s.d)
    key = F.unhex(F.array_join(F.transform(F.slice("path", 1, SPLITTER_TURNS), lambda s: F.hex(s.d)), ""))
    dealt = paths.select("conv_id", steps.alias("steps"), F.transform("path", lambda s: s.n).alias("chars"),
                         shard_of(key, "conv_id").alias("shard"))
    shards_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "steps", "conv_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SHARD.split(", ")]
        schema = pa.schema([pa.field(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]])
                            for n, f in zip(names, _SHARD.split(", "))])

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(b.slice(at, 256).column(c).to_pylist() for c in ("shard", "conv_id", "steps", "chars")))

        out = []
        for node in walk_shards(rows(), skeleton.value, TaskContext.get().partitionId()):
            out.append(node)
            if len(out) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    found = stored(shards_.mapInArrow(walk, _SHARD), "trie-nodes")
    ends = (found.filter("kind = 2").select("node", F.col("conv_id").alias("first"), "ends")
            .repartition(F.col("node")).sortWithinPartitions("node", "first").mapInArrow(_join_runs, "node bigint, sha string"))
    partial = found.filter("kind = 1").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("chars").alias("chars"))
    empty = hashlib.sha256(b"").hexdigest()
    whole = partial.join(ends, "node", "left").withColumn("sha", F.coalesce("sha", F.lit(empty)))
    # one row for each node of the skeleton, which the driver has made
    top = stored(whole.groupBy(F.lit(0).alias("all")).applyInArrow(
        _finish_skeleton, "node bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
                          "n_leaves bigint, saved_tokens bigint, sha string"), "trie-skeleton")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    done = [F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.col("ends").alias("ends_sha256")]
    above_top = F.broadcast(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    # a node's smallest member is known when the shard has passed all of them, so its children look it up
    above = found.filter("kind in (0, 3) and n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below_top = found.filter("kind = 3").join(above_top, "parent").select("conv_id", *done)
    below = found.filter("kind = 0").join(above, "parent").select("conv_id", *done)
    return below.union(below_top).union(top.withColumn("ends_sha256", F.col("sha")).select(out))
