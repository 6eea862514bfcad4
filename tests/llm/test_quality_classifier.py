import zlib

import numpy as np

from tallyglass.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    n = qc.N_STRUCTURE + 16
    m = qc.Machine(np.zeros(qc.N_STRUCTURE, np.float32), np.ones(qc.N_STRUCTURE, np.float32), 0.3, rng.normal(size=n).astype(np.float32), rng.normal(size=(n, 3)).astype(np.float32))
    at, value = [np.array([1, 5], np.int32), np.array([], np.int32)], [np.array([0.6, 0.8], np.float32), np.array([], np.float32)]
    index, x, first = m.rows(rng.normal(size=(2, qc.N_STRUCTURE)).astype(np.float32), at, value)
    got, _ = m.margin(index, x, first)
    for d, (a, b) in enumerate(zip(first, [*first[1:], len(index)], strict=True)):
        i, v = index[a:b], x[a:b]
        want = m.bias + (m.weight[i] * v).sum() + sum(m.factor[i[p]] @ m.factor[i[q]] * v[p] * v[q] for q in range(len(i)) for p in range(q))
        assert abs(got[d] - want) < 1e-3


def test_query_on_held_out_rows(spark):
    out = {r.doc_id: r for r in qc.op10(spark, SF).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(out) == docs
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(out[i].score, q) for i, q in labels.items() if out[i].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "some words here", 1), (3, "some words here", 1), (None, "x " * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (9, 0), (None, 0), (2, None)], "doc_id long, quality int")
    machine = qc.train(docs, labels)
    out = qc.scored(docs, machine).collect()
    assert len(out) == 5 and all(0 < r.score < 1 for r in out)
    assert qc.keep_good(docs, machine).columns == docs.columns
    nothing = qc.train(docs.limit(0), labels.limit(0))
    assert {round(r.score, 3) for r in qc.scored(docs, nothing).collect()} == {0.5}
    assert qc.scored(docs.limit(0), nothing).count() == 0


def test_scores_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    known = [(i, t) for i, t in rows if i in labels]
    machine = qc.fit([qc.inputs(t.encode() if t else None) for _, t in known], np.array([labels[i] for i, _ in known], np.float32), epochs=4)
    out = {r.doc_id: r for r in qc.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), machine).collect()}
    for i, text in rows[:40]:
        form, at, value = qc.inputs(text.encode() if text else None)
        k = len(form)
        x = {j: float(v) for j, v in enumerate(np.clip((form - machine.mean) / machine.scale, -4, 4) / np.sqrt(k))}
        x |= {k + int(a): float(v) for a, v in zip(at, value)}
        if len(x) > 400:
            continue
        keys = sorted(x)
        total = machine.bias + sum(float(machine.weight[j]) * x[j] for j in keys)
        for p, a in enumerate(keys):
            total += sum(float(machine.factor[a] @ machine.factor[b]) * x[a] * x[b] for b in keys[:p])
        assert abs(out[i].score - 1 / (1 + np.exp(-total))) < 1e-3
        assert out[i].predicted == int(out[i].score >= qc.THRESHOLD)
        words = (text or "").encode().translate(qc._LOWER).split()
        assert len(at) <= len(set(words)) and (not words or abs(float((value**2).sum()) - 1) < 1e-4)
