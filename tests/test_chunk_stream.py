from pyspark.sql import functions as F

from cadence.operators import runs
from cadence.session import scratch_path
from cadence.sources.chunks import ChunkedReader

ROWS = [(i, (i * 7919) % 1013, float(i) if i % 5 else None, f"t{i}" if i % 7 else None) for i in range(1013)]


def _frame(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "id int, ts int, x double, s string")
    return df.withColumn("at", F.timestamp_seconds("ts")).withColumn("day", F.to_date("at")).repartition(5)


def _run(stream, seen, checkpoint, **trigger):
    def keep(batch, epoch):
        rows = [tuple(r) for r in batch.collect()]
        if rows:
            seen.append(rows)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    try:
        q.awaitTermination() if "availableNow" in trigger else q.processAllAvailable()
    finally:
        q.stop()


def test_one_chunk_a_batch_in_order(spark):
    df = _frame(spark)
    r = ChunkedReader(df, ["ts"], 100)
    seen = []
    _run(r.stream(), seen, scratch_path(spark, "chunk-stream-1"), processingTime="0 seconds")
    assert [len(b) for b in seen] == [100] * 10 + [13]
    want = [[tuple(x) for x in c.collect()] for c in r]
    assert [sorted(b, key=lambda x: x[1]) for b in seen] == want


def test_a_restart_goes_on_behind_the_last_chunk(spark):
    r = ChunkedReader(_frame(spark), ["ts"], 300)
    stream, seen, ck = r.stream(), [], scratch_path(spark, "chunk-stream-2")
    for _ in range(2):  # one chunk each
        _run(stream, seen, ck, availableNow=True)
    _run(stream, seen, ck, processingTime="0 seconds")
    assert [len(b) for b in seen] == [300, 300, 300, 113]
    assert sorted(x[0] for b in seen for x in b) == list(range(1013))


def test_an_empty_collection_streams_nothing(spark):
    r = ChunkedReader(_frame(spark).limit(0), ["ts"], 10)
    seen = []
    _run(r.stream(), seen, scratch_path(spark, "chunk-stream-3"), processingTime="0 seconds")
    assert seen == []


def test_preceding_values_cross_several_buckets(spark):
    rows = [(u, t, None if t % 11 == 3 else f"s{t}") for u in ("a", None) for t in (0, 1, 5, 12, 13, 40, 41, 42, 43, 99)]
    df = spark.createDataFrame(rows, "u string, t int, s string").repartition(3)
    got = runs.preceding(df, "s", 3, ["t"], partition_by=["u"], bucket=F.floor(F.col("t") / 2)).collect()
    assert len(got) == len(rows)
    for r in got:
        before = [s for u, t, s in sorted((x for x in rows if x[0] == r["u"]), key=lambda x: x[1]) if t < r["t"]][-3:]
        assert [p["v"] for p in r["prev"]] == before
