"""From raw documents to encoded training data, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` with ``docs`` as the stage before
wrote them, works on all of them, and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes every stage's result to the
shared folder and rereads it, so a stage that is done is never computed again.

Null, empty and repeated rows, ties and extra columns are handled as each
operator's docstring says; an empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadence.llm import encoding, language_id, mixing, near_dedup, suffix_dedup
from cadence.llm._tables import stored


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is undetermined (no text, no letter) go; only these, also if no row has a label."""
    return language_id.drop_unidentified(docs, language_id.fit(docs, ~language_id.held_out()))


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one row of each group stays."""
    return near_dedup.drop_near_duplicates(docs, one_row=True)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: passages of 50 bytes or more that a smaller document has are cut out."""
    return suffix_dedup.drop_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are left out or repeated so that sources reach their target weights."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the token ids of each document, with digests of the ids and of what they decode to."""
    return encoding.encode(docs)


STAGES = [
    ("language_id", keep_identified),
    ("near_dedup", keep_first_of_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Near-duplicate components, repeated strings and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
