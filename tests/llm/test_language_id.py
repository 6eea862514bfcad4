import zlib
from collections import Counter

import numpy as np

from tallyglass.llm import language_id as li

SF = "/root/testdata/sf0.01"


def _brute_bundle(text, encoder):
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    seq = [0]
    for c in letters + [0]:
        if c or seq[-1]:
            seq.append(c)
    if len(seq) < 3:
        return np.zeros(encoder.dimensions)
    grams = Counter(zip(seq, seq[1:], seq[2:]))
    return sum(n * np.roll(encoder.letter(a), 2).astype(int) * np.roll(encoder.letter(b), 1) * encoder.letter(c) for (a, b, c), n in grams.items())


def test_bundle_matches_definition(monkeypatch):
    encoder = li.Encoder(64)
    texts = ["", "123 !", "a", "Ab, ab  ABC\n", "Straße ÉTÉ", "日本語のテスト", "x" * 5000, " " * 50 + "q"]
    for most in (8192, 3):
        monkeypatch.setattr(li, "_TRIGRAMS_AT_ONCE", most)
        got = encoder.bundle(texts)
        for t, v in zip(texts, got, strict=True):
            assert (v == _brute_bundle(t, encoder)).all(), t


def test_query_on_held_out_rows(spark):
    out = li.op6(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_edges(spark):
    train = spark.createDataFrame([(1, "aaa bbb aab", "A"), (2, "xyz zyx yyy", "B"), (3, None, "C"), (4, "text", None)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(1, None, 1, "q"), (2, "1 2", 1, "q"), (3, "aab", 1, "q"), (3, "aab", 1, "q"), (None, "zyx", 1, "q")], "doc_id long, text string, score int, lang_pred string")
    out = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 6)) for r in li.identify(docs, train).collect())
    assert [x[:2] for x in out] == [(0, "B"), (1, "und"), (2, "und"), (3, "A"), (3, "A")] and out[3] == out[4]
    assert li.identify(docs.limit(0), train).count() == 0
    assert {r.lang_pred for r in li.identify(docs, train.limit(0)).collect()} == {"und"}


def test_predictions_match_brute_force_in_any_layout(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    train, test = rows[:60], rows[60:120] + [(900, "Ωmega ßeta", None), (901, "12 34", None)]
    encoder = li.Encoder(128)

    def direction(v):
        return v / (np.sqrt((v.astype(float) ** 2).sum()) or 1.0)

    langs = sorted({lang for _, t, lang in train if lang and t})
    prototypes = [direction(sum(direction(_brute_bundle(t, encoder)) for _, t, x in train if x == lang and t)) for lang in langs]
    centred = [direction(p - sum(prototypes) / len(prototypes)) for p in prototypes]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(test, schema)
    got = {r.doc_id: r for r in li.identify(docs.repartition(2), spark.createDataFrame(train, schema), dimensions=128).collect()}
    other = {r.doc_id: r for r in li.identify(docs.repartition(5, "text"), spark.createDataFrame(train, schema), dimensions=128).collect()}
    assert got == other
    for i, text, _ in test:
        v = _brute_bundle(text or "", encoder)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = [direction(v) @ c for c in centred]
        assert abs(got[i].score - (1 + max(cosines)) / 2) < 1e-5
        assert got[i].lang_pred == langs[int(np.argmax(cosines))] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-5
