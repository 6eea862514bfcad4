import random

import pytest

from tallyglass.llm import decontamination as dc


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


ITEMS = [
    (1, " ".join(f"w{i}" for i in range(20))),
    (2, "Short item, of six words only"),
    (10, "one"),
    (3, None),
    (4, "...!"),
    (5, " ".join(f"w{i}" for i in range(20))),
]


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(20)] + ["été", "X-Ray", "a"]
    texts = [None, "", "?!", "ONE", "w0 w1", " ".join(f"W{i}" for i in range(25)), "short ITEM of\nsix words: only!"]
    for _ in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
        if rnd.random() < 0.5:
            a = rnd.randint(0, 7)
            words[3:3] = [f"w{i}" for i in range(a, a + 13)]
        texts.append(" ".join(words))
    texts.append(" ".join(f"z{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(20)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {i: dc.brute(t, ITEMS) for i, t in enumerate(texts)}
    for most in (1 << 20, 40):  # one slice, and many
        got = _rows(dc.verdicts(docs, bench, max_slice_bytes=most))
        for i in want:
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[i], (i, most)


def test_empty_tables_and_extra_columns(spark):
    schema = "doc_id long, text string, __scan int, n_words int, items string"
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.verdicts(spark.createDataFrame([], schema), bench).count() == 0
    docs = spark.createDataFrame([(1, "a b", 1, 2, "x"), (1, "a b", 1, 2, "x"), (None, "one", 1, 2, "x")], schema)
    out = dc.verdicts(docs, bench)
    assert out.count() == 3 and all(not r.contaminated for r in out.collect())


def test_spans_and_documents(spark):
    passage = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Hello, {passage.upper()}; bye."), (2, "clean text"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [2, 3]
    spans = _rows(dc.decontaminate(docs, bench, "spans"))
    assert spans[1].text == "Hello, ; bye." and spans[2].text == "clean text" and spans[3].text is None
    with pytest.raises(ValueError):
        dc.decontaminate(docs, bench, "words")


def test_rows_pass_whole(spark):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "two", 5, "x", 7), (2, "one", 5, "x", 7)], "doc_id long, text string, __scan int, row string, `a.b` int")
    for mode in ("documents", "spans"):
        out = dc.decontaminate(docs, bench, mode)
        assert out.columns == docs.columns and out.collect()[0] == docs.collect()[0]
