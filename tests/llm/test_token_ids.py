import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyglass.llm import huffman as hf
from tallyglass.llm import token_ids as ti
from tallyglass.llm import tokens


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n in (2, 3, 7, 300):
        counts = rng.zipf(1.5, n).astype(np.int64)
        free = hf.code_lengths(counts, 40)
        assert (counts * free).sum() == hf.plain_lengths(counts)
        for limit in range((n - 1).bit_length() or 1, 12):
            bits = hf.code_lengths(counts, limit)
            assert bits.max() <= limit and (2.0 ** -bits.astype(float)).sum() == 1
            assert (counts * bits).sum() >= (counts * free).sum()
    assert hf.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        hf.code_lengths(np.ones(9, np.int64), 3)


def test_limited_lengths_match_exhaustive_search():
    from itertools import product

    counts = np.array([1, 1, 2, 9, 30])
    best = min(sum(c * b for c, b in zip(counts, bits)) for bits in product(range(1, 4), repeat=5) if sum(2.0**-b for b in bits) <= 1)
    assert (counts * hf.code_lengths(counts, 3)).sum() == best


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 255, 256, 257, 512, 5000):
        ids = (rng.zipf(1.2, n) % 5000).astype(np.uint32)
        codec = hf.limited(np.bincount(ids, minlength=5000))
        block = codec.encode(ids)
        assert (codec.decode(block) == ids).all()
        for _ in range(5):
            a = int(rng.integers(0, n + 1))
            k = int(rng.integers(0, n - a + 1))
            assert (codec.decode_range(block, a, k) == ids[a : a + k]).all()
    with pytest.raises(ValueError):
        codec.decode(block[:-1])


def test_documents(spark, tmp_path):
    rnd = random.Random(1)
    texts = [None, "", "a", "The the THE", "word " * 3000] + [" ".join(rnd.choice(["le", "the", "und", "Straße,", "x\n"]) for _ in range(rnd.randint(1, 500))) for _ in range(80)]
    ids = list(range(0, 2 * len(texts), 2))
    rows = [(i, t, 1, 2) for i, t in zip(ids, texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, payload int").repartition(4)
    for k, block in enumerate((1 << 20, 500)):
        path = str(tmp_path / f"ids{k}")
        ti.write_ids(docs, path, block_ids=block)
        got = {r.doc_id: r for r in ti.read_ids(spark, path, with_ids=True).collect()}
        reference, start = Tokenizer.from_file(tokens.public_path(ti.TOKENIZER)), 0
        for i, t in zip(ids, texts):
            want = reference.encode(t or "", add_special_tokens=False).ids + [1]
            r = got[i]
            assert (r.start, r.n_tokens, r.ids_crc32, list(r.ids)) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
            start += len(want)


def test_repeated_rows_null_ids_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(5, "a"), (5, "a"), (5, "b c"), (None, "d")], "doc_id long, text string")
    ti.write_ids(docs, str(tmp_path / "a"))
    out = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in ti.read_ids(spark, str(tmp_path / "a")).collect())
    assert out[0][2] == -1 and [s for s, _, _ in out] == np.cumsum([0] + [n for _, n, _ in out[:-1]]).tolist() and len(out) == 4
    ti.write_ids(docs.limit(0), str(tmp_path / "b"))
    assert ti.read_ids(spark, str(tmp_path / "b")).count() == 0
