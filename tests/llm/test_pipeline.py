import corpus_pipeline as pipeline
from tallyhouse.llm import decontam, langid, neardup, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_run_is_their_composition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, function in pipeline.STAGES[:-1]:
        after = function(spark, docs, SF).cache()
        assert after.columns == columns
        ids = {r.doc_id for r in after.collect()}
        assert ids <= kept[-1]
        if name == "near_duplicates":
            found = neardup.near_duplicates(docs).collect()
            assert ids == {r.component_id for r in found}
        if name == "decontamination":
            bad = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
            assert bad and ids == kept[-1] - bad
        kept.append(ids)
        docs = after
    packed = sorted(map(tuple, pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert {r[0] for r in packed} == kept[-1]
    assert packed == sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_language_stage_drops_what_has_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, "x", 0), (-2, "12 34 ...", "en", "x", 9)], docs.schema)
    left = {r.doc_id for r in pipeline.identify_language(spark, docs.union(odd), SF).collect()}
    assert not left & {-1, -2}
    sure = langid.identify(docs, langid.train(docs)).where("not lang_ambiguous and lang_pred <> 'und'")
    assert left == {r.doc_id for r in sure.collect()}


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, function in pipeline.STAGES:
        out = function(spark, docs, SF)
        assert out.collect() == []
        if name != "packing":
            assert out.columns == docs.columns


def test_all_eleven_are_registered():
    names = queries.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
