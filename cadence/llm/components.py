"""Connected components of a written edge table, without collecting anything.

Each round sends the smaller label across every edge in both directions,
keeps the minimum per node, then lets each label point to its own label
(pointer jumping). Labels settle in a number of rounds logarithmic in a
component's longest chain. Joins start at written tables, so a node with very
many edges may be split; minima are pre-aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._tables import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as written by ``stored`` -> (node, label), label the
    smallest node that is reachable; nodes without an edge are not listed."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        sent = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label")
        hooked = stored(labels.union(sent).groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = hooked.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        jumped = stored(hooked.join(up, hooked.label == up.n2).select("node", F.col("l2").alias("label")), "labels")
        old = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        changed = jumped.join(old, (jumped.node == old.n2) & (jumped.label != old.l2)).limit(1).count()
        discard(labels, hooked)
        labels = jumped
        if not changed:
            discard(both)
            return labels
