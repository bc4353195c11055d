from fixtures import components, edge_docs

import corpus_pipeline
from trigrove.llm import decontaminate, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_part(spark, tmp_path):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id for r in after.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.scored(before, model).collect() if not r.predicted}
        elif name == "near-duplicates":
            want = set(components([(r.doc_id, r.text) for r in before.collect()], 80, 100)[0].values())
        elif name == "decontamination":
            tests = spark.read.parquet(f"{SF}/benchmark.parquet")
            want = {r.doc_id for r in before.collect()} - {r.doc_id for r in decontaminate.contaminated(before, tests).collect()}
            for r in tests.collect():  # whole copies at least are gone
                assert not any(r.text in (x.text or "") for x in after.collect())
        else:
            want = {r.doc_id for r in before.collect()}
            assert sorted(r.mix_position for r in after.collect()) == list(range(len(want)))
        assert got == want
        assert after.columns == columns if k < 3 else set(columns) < set(after.columns)
        before = after
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(got)


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"  # the smallest has too few labels
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.remove_toxic(spark, docs, sf).select("doc_id").collect()}
    want = {r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect() if not r.predicted}
    told = {r.doc_id: r.toxic for r in labels.collect()}
    assert left == want
    assert sum(1 for d, y in told.items() if not y and d not in left) <= 0.02 * len(told)
    assert sum(1 for d, y in told.items() if y and d not in left) >= 0.7 * sum(told.values())


def test_stages_on_edges(spark):
    for empty in (False, True):
        docs = edge_docs(spark, empty)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "mixing":
                assert out.columns == docs.columns
            assert out.count() <= docs.count() and (not empty or out.count() == 0)
