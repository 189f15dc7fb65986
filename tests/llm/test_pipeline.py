import corpus_pipeline
from tessel.llm import kneser_ney, quality_rules, scratch
from tests.llm.test_operators import components_of, shingles

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.save(stage(spark, tables[-1], SF), f"test-{i}")
        if i < 4:
            assert out.columns == columns
        tables.append(out)
    ids = [[r.doc_id for r in t.select("doc_id").collect()] for t in tables]
    kept = {r.doc_id for r in quality_rules.assess(docs, quality_rules.train(docs, labels)).filter("kept").collect()}
    assert set(ids[1]) == kept and len(kept) < len(ids[0])
    kept = {r.doc_id for r in kneser_ney.assess(tables[1], kneser_ney.fit(tables[1], labels)).filter("kept").collect()}
    assert set(ids[2]) == kept
    texts = {r.doc_id: r.text for r in tables[2].collect()}
    sets = [shingles(t, 5) for t in texts.values()]
    found = components_of(sets, list(texts), lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b))
    assert sorted(ids[3]) == sorted(set(found.values())) and len(ids[3]) < len(ids[2])
    assert set(ids[4]) <= set(ids[3]) and sorted(ids[5]) == sorted(ids[4])
    assert corpus_pipeline.run(spark, SF).count() == len(ids[5])


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0




def test_heaps_are_collected_before_each_stage(spark, monkeypatch):
    beans = lambda: [b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()]
    before = beans()
    scratch.collect_heaps(spark)
    assert sum(beans()) > sum(before)
    seen = []
    monkeypatch.setattr(corpus_pipeline, "collect_heaps", seen.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, SF)
        assert len(seen) == i + 1
