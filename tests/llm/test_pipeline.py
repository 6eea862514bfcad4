import corpus_pipeline as cp
from tallyglass.llm import decontamination as dc
from tallyglass.llm import packing as pk
from tallyglass.llm import quality_classifier as qc
from tallyglass.llm import substring_dedup as sd
from tests.llm.test_packing import _check
from tests.llm.test_near_similar import brute_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns, tables = source, source.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
        tables.append(docs)
    before = {r.doc_id: r for r in source.collect()}
    scores = {r.doc_id: r.score for r in qc.op10(spark, SF).collect()}
    after = {r.doc_id: r for r in tables[0].collect()}
    assert set(after) == {i for i, s in scores.items() if s >= 0.3} and all(after[i] == before[i] for i in after)
    ids = sorted(after)
    kept = {ids[c] for c in brute_groups([after[i].text for i in ids])}
    before, after = after, {r.doc_id: r for r in tables[1].collect()}
    assert set(after) == kept and all(after[i] == before[i] for i in after)
    before, after = after, {r.doc_id: r for r in tables[2].collect()}
    ids = sorted(before)
    assert set(after) == set(before)
    for i, (_, removed, _) in zip(ids, sd.brute([before[j].text for j in ids]), strict=True):
        if removed:
            assert len(after[i].text.split()) == len(before[i].text.split()) - removed and after[i].n_chars == len(after[i].text)
        else:
            assert after[i] == before[i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = after, {r.doc_id: r for r in tables[3].collect()}
    assert set(after) == {i for i, r in before.items() if not dc.brute(r.text, items)[4]} and all(after[i] == before[i] for i in after)
    rows = tables[4].collect()
    assert {r.doc_id for r in rows} == set(after)
    _check([(r.length, r.sequence_id, r.offset) for r in rows], pk.CAPACITY)


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
