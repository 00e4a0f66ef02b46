"""Mixing sources to target weights by systematic sampling (native Spark).

Sources get targets by weight, none above ``max_repeat`` times its own size.
Within a source every document expects ``target / source size`` copies; the
prefix sum of these expectations plus one random offset of the source crosses
an integer once for each copy that the mix emits. Documents stand in order of
size class, so that neighbours on the sampling line are of like size and the
words taken come close to the target.

Nothing but DataFrame functions runs here, and no window holds a whole source:
positions are summed over (source, size class), over at most ``slots`` slots of
a class, and numbered within one slot.

Defined results: a null or empty text has size 0; a null source is a source of
its own and stands last; a null ``doc_id`` falls in slot 0 after the others;
repeated rows are documents of their own; an empty table gives an empty mix; a
table without any word has targets of 0 and takes nothing. Extra columns are
kept by ``mix`` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm._tables import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """``source_key, source_size, target`` of each source; ``sizes`` has a row
    per source with ``source_key, source, source_size``.

    The weights repeat over the sources by code point, null last. Ordered by
    capacity per weight, the capped sources come first, so one running sum
    finds the common level: the first source whose capacity lies above what
    the caps before it leave to the rest sets that level. The two windows hold
    one row per source, nothing that grows with documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    nth = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    t = sizes.select("source_key", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth).alias("w"),
                     (F.col("source_size") * F.lit(float(max_repeat))).alias("cap"))
    ratio = F.col("cap") / F.col("w")
    by_ratio = Window.orderBy(ratio, "source_key")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("cap").over(upto) - F.col("cap"))
    level = left / (F.sum("w").over(every) - (F.sum("w").over(upto) - F.col("w")))
    t = t.withColumn("ratio", ratio).withColumn("level", level)
    common = F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every)
    return t.withColumn("common", common).select(
        "source_key", "source_size",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("w"))).alias("target"))


def offset_of(source):
    """The random offset of a source in [0, 1): 20 bits of its name's digest, plus half a step."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")).cast("binary")), 1, 5),
                  16, 10).cast("double")
    return (bits + 0.5) / float(1 << 20)


def _keyed(docs: DataFrame, carry: bool, slots: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The numbering keys of each document; ``carry`` keeps the whole row beside them."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                    *([F.struct(*docs.columns).alias("row")] if carry else []))
    digits = F.col("size").cast("string")
    return t.select("*", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
                    F.length(digits).alias("digits"), F.substring(digits, 1, 1).alias("lead"),
                    F.coalesce(F.pmod("doc_id", F.lit(slots)), F.lit(0)).cast("int").alias("slot"))


def plan_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_repeat: float = 3,
             slots: int = 256, carry: bool = False, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken``
    (and its whole ``row`` if ``carry``)."""
    names = (slots, id_col, text_col, source_col)
    narrow = stored(_keyed(docs, False, *names), "mix-sizes")
    group, cell = ["source_key", "digits", "lead"], ["source_key", "digits", "lead", "slot"]
    cells = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("before_slot", F.sum("n").over(Window.partitionBy(*group).orderBy("slot")) - F.col("n"))
    classes = narrow.groupBy(*group, "source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    totals = classes.groupBy("source_key", "source").agg(F.sum("words").cast("long").alias("source_size"))
    in_source = Window.partitionBy("source_key").orderBy("digits", "lead")
    classes = classes.select(*group, (F.sum("n").over(in_source) - F.col("n")).alias("before_class"))
    starts = stored(cells.join(classes, group).join(source_targets(totals, weights, share, max_repeat), "source_key")
                    .select(*cell, "source_size", "target", (F.col("before_class") + F.col("before_slot")).alias("before")),
                    "mix-starts")
    rows = _keyed(docs, True, *names) if carry else narrow
    in_cell = Window.partitionBy(*cell).orderBy("size", F.col("doc_id").asc_nulls_last())
    t = rows.withColumn("nth", F.row_number().over(in_cell)).join(starts, cell)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at, u = F.col("before") + F.col("nth"), offset_of(F.col("source"))
    copies = F.least(F.floor(u + each * at) - F.floor(u + each * (at - 1)), F.ceil(F.lit(float(max_repeat))))
    return (t.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(["row"] if carry else [])))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the plan takes it."""
    plan = plan_mix(docs, carry=True, **options).filter("copies > 0")
    return plan.select(F.explode(F.expr("sequence(1L, copies)")).alias("copy_no"), "row").select("row.*")
