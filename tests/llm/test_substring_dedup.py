import random

import numpy as np

from tallyglass.llm import substring_dedup as sd


def _texts():
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(4000)]
    shared = [[rnd.choice(vocab) for _ in range(n)] for n in (35, 36, 50, 120)]
    texts = [None, "", " \n\t", "only five words are here", " ".join(["same"] * 500), "x" * 10_000]
    for _ in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 200))]
        if rnd.random() < 0.6:
            at = rnd.randint(0, len(words))
            words[at:at] = rnd.choice(shared)
        texts.append(rnd.choice([" ", "  ", "\n", "\t"]).join(words))
    texts += [texts[10]] * 3 + [texts[11].upper()]
    base = [rnd.choice(vocab) for _ in range(100)]
    texts.append(" ".join(base + ["mid"] + base))  # repeats itself
    texts.append("a b " * 40 + " ")  # only ASCII white space separates
    texts.append(" ".join(rnd.choice(vocab) for _ in range(30_000)) + " " + " ".join(base))
    return texts


def test_matches_brute_force(spark):
    texts = _texts()
    want = sd.brute(texts)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ranges string, bucket int").repartition(3)
    for block_words in (1 << 21, 1000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.removal_digests(docs, block_words=block_words).collect()}
        assert got == dict(enumerate(want)), block_words


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "short"), (None, None)], "doc_id long, text string")
    out = sd.removal_digests(docs).collect()
    assert sorted((r.n_words, r.n_removed) for r in out) == [(0, 0), (1, 0), (40, 40), (40, 40)]
    assert sd.removal_digests(docs.limit(0)).count() == 0


def test_dedup_keeps_untouched_texts_and_columns(spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, f"one  two {shared} end", "k"), (2, f"{shared}\nmore", "k"), (3, "un touched\n  text", "k"), (4, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    out = {r.doc_id: r for r in sd.dedup(docs).collect()}
    assert [out[i].text for i in (1, 2, 3, 4)] == ["one two end", "more", "un touched\n  text", None]
    assert out[1].key == "k" and sd.dedup(docs).columns == docs.columns


def test_history_runs_and_compaction(spark, tmp_path):
    shared = " ".join(f"s{i}" for i in range(40))
    old = spark.createDataFrame([(1, shared + " a b c"), (2, " ".join(f"o{i}" for i in range(60)))], "doc_id long, text string")
    older = spark.createDataFrame([(8, " ".join(f"h{i}" for i in range(60)))], "doc_id long, text string")
    new = spark.createDataFrame([(3, "new " + shared), (4, " ".join(f"n{i}" for i in range(60))), (5, " ".join(f"h{i}" for i in range(5, 45)))], "doc_id long, text string")
    index = sd.FingerprintIndex(spark, str(tmp_path / "index"), buckets=8)
    index.append(older)
    index.append(old)
    assert len(index.runs()) == 2
    want = {3: 40, 4: 0, 5: 40}
    assert {r.doc_id: r.n_removed for r in sd.removal_digests(new, index).collect()} == want
    index.compact()
    assert len(index.runs()) == 1
    assert {r.doc_id: r.n_removed for r in sd.removal_digests(new, index).collect()} == want


def test_packing_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        v = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (sd._unpack(sd._pack(v)) == v).all()
        p = rng.integers(0, 2**24, n)
        assert (sd._unpack3(sd._pack3(p)) == p).all()


def test_words_of_one_polynomial_hash_differ(spark):
    """Thue-Morse words, which agree in every polynomial hash modulo a power of two, and windows patterned like them."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    same = " ".join(f"s{i}" for i in range(17))
    texts = [f"{same} {a} {same}", f"{same} {b} {same}", " ".join([a, "b"][x] for x in bits[:35]), " ".join(["b", a][x] for x in bits[:35])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.removal_digests(docs).collect()}
    assert got == dict(enumerate(sd.brute(texts)))
    assert all(n == 0 for _, n, _ in got.values())
