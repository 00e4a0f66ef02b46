"""The pipeline's stages one after the other, against plain Python."""


import corpus_pipeline
from cadence.llm import encoding, mixing
from tests.llm.test_dedup import brute_components, brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "mixing", "byte_bpe"]
    import __spark_entry__ as E

    assert {f"op{i}_" for i in range(1, 14)} == {n.split("_")[0] + "_" for n in E.queries() if n[:2] == "op" and n[2].isdigit()}
    assert E.queries()["pipeline"] is corpus_pipeline.run


def test_stages_against_brute_force(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text[:1500], r.lang, r.source, len(r.text[:1500])) for r in src]
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, "12 !", "en", "a", 4), (1003, rows[0][1], "en", None, rows[0][4]),
             (1004, "short", "en", "b", 5), (1005, rows[3][1][:200] + " new end", "en", "b", 208)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(r.doc_id for r in out["language_id"]) == sorted(r[0] for r in kept)
    first = {e[0] for e in brute_components([(r[0], r[1]) for r in kept], 5, 80) if e[0] == e[2]}
    kept = [r for r in kept if r[0] in first]
    assert sorted(r.doc_id for r in out["near_dedup"]) == sorted(first)
    cut = {e[0]: e[5].decode("utf-8", "ignore") for e in brute_spans([(r[0], r[1]) for r in kept], 50)}
    assert {r.doc_id: r.text for r in out["suffix_dedup"]} == cut
    plan = mixing.plan_mix(spark.read.parquet(str(tmp_path / "suffix_dedup"))).collect()
    assert sorted(r.doc_id for r in out["mixing"]) == sorted(r.doc_id for r in plan for _ in range(r.copies))
    v = encoding.vocabulary("byte_bpe_50k.tiktoken")
    assert sorted((r.doc_id, tuple(r.ids)) for r in out["byte_bpe"]) == sorted((r.doc_id, tuple(v.encode(r.text))) for r in out["mixing"])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_table_without_labels_passes_the_first_stage(spark):
    rows = [(1, "one text of words", None, "a", 17), (2, "12 !", None, "a", 4), (3, None, None, None, None), (5, "zwei", None, "b", 4)]
    out = corpus_pipeline.keep_identified(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 5]
