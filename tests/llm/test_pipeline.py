import corpus_pipeline
from lodestar.llm import decontamination, quality, secrets, wide_simhash
from tests.llm.helpers import EDGE, DOC, docs, prose


def test_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "benchmark decontamination", "secret scans", "packing"]
    start = spark.read.parquet(f"{small}/documents.parquet")
    now, seen = start, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == start.columns and now.dtypes == start.dtypes
        seen.append({r.doc_id: r for r in now.collect()})
    good, single, clean, masked = seen
    report = {r.doc_id: r.kept for r in quality.quality_report(start).collect()}
    assert set(good) == {k for k, v in report.items() if v}
    kept = start.where(start.doc_id.isin(list(good)))
    groups = {r.doc_id: r.component for r in wide_simhash.grouped(kept).collect()}
    assert set(single) == set(groups.values())
    hits = {r.doc_id for r in decontamination.contaminations(start, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(clean) == set(single) - hits and hits & set(single)
    assert set(masked) == set(clean)
    for k, r in masked.items():
        assert not secrets.base_spans(r.text) and (r.text == clean[k].text or secrets.MASK in r.text)
        assert r.n_chars == (clean[k].n_chars if r.text == clean[k].text else len(r.text))
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == set(masked)


def test_stages_on_edges(spark, small):
    now = docs(spark, [*EDGE, prose(80), prose(80), prose(90, 2)]).unionByName(docs(spark, [prose(70, 5)], 12))
    nulls = spark.createDataFrame([(None, None, None, None, None)], DOC)
    for start in (now.unionByName(nulls), now.limit(0)):
        at = start
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, small)
        at.collect()
