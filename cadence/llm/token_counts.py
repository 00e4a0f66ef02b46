"""Token counts through a digest cache.

Counts are stored by two digests: that of the normalised content (a null text
is the empty one; byte-level vocabularies have no normaliser, so nothing else
may be folded without changing counts) and that of the tokenizer version (its
file's bytes and its library's version). A run joins the content digests to
the stored counts, encodes each distinct miss once with the tokenizer's own
library, appends the new counts to the cache, and answers from the cache.

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any
length are counted whole; repeated rows and equal texts of different rows are
encoded once and each answered; null ids are kept; an empty table gives an
empty result; extra columns are never read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm._tables import new_path, ready, stored

#: White space of the Unicode property that ``\\s`` of the pattern means.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Segments that a worker remembers before it starts anew, and their longest length.
CACHE, CACHE_CHARS = 1_200_000, 64

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and its library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"\0" + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def _whole_counter(path: str):
    """texts -> counts by the library, without added special tokens."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def cuts_at_white_space(path: str) -> bool:
    """Whether the counts of segments between white space add up to the
    text's: the byte-level pre-tokenizer with its own pattern, no normaliser,
    and added tokens that hold no white space and strip none."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j.get("pre_tokenizer") or {}
    added = j.get("added_tokens") or []
    return (j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added))


class Counter:
    """Counts of texts by the tokenizer's library; where counts add up over
    segments, each distinct segment goes through the library once."""

    def __init__(self, path: str):
        self.count_all = _whole_counter(path)
        self.additive = cuts_at_white_space(path)
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.additive:
            return self.count_all(texts)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for text in texts:
            parts = SEGMENT.findall(text)
            try:
                out.append(sum(map(known.__getitem__, parts)))
                continue
            except KeyError:
                pass
            new = [p for p in set(parts) if p not in known]
            counts = dict(zip(new, self.count_all(new)))
            known.update((p, n) for p, n in counts.items() if len(p) <= CACHE_CHARS)
            out.append(sum(known[p] if p in known else counts[p] for p in parts))
        return out


_counters: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if name not in _counters:
        _counters[name] = Counter(public_tokenizers.path(name))
    return _counters[name]


def _count_misses(misses: DataFrame, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the remembered counts hold no cycles
        count = _counter(name)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(count(part.column("content").to_pylist()), pa.int64())],
                    names=["digest", "n_tokens"])

    return misses.select("digest", "content").mapInArrow(run, "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an empty cache where there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache_path: str | None = None,
                 text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row. ``cache_path`` names a cache
    to read and extend; without it the run keeps one of its own."""
    import public_tokenizers

    spark = docs.sparkSession
    ready(spark)
    cache_path = cache_path or new_path(spark, "token-cache")
    version = tokenizer_version(public_tokenizers.path(tokenizer))
    content = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    texts = docs.select(digest.alias("digest"), content.alias("content"))
    old = read_cache(spark, cache_path).filter(F.col("version") == version).select("digest", "n_tokens")
    misses = texts.groupBy("digest").agg(F.first("content").alias("content")).join(old, "digest", "left_anti")
    (_count_misses(misses, tokenizer).select(F.lit(version).alias("version"), "digest", "n_tokens")
     .write.mode("append").parquet(cache_path))
    known = read_cache(spark, cache_path).filter(F.col("version") == version)
    # two runs at the same time may both have appended a text
    known = stored(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-known")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"),
                              F.octet_length(content).cast("long").alias("n_bytes")), "token-rows")
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens")
