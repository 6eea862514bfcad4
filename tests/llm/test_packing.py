import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyglass.llm import packing as pk
from tallyglass.llm import tokens


def _check(rows, capacity):
    """Sequences are filled from 0 without gaps or overlaps, within the capacity; their number."""
    by = {}
    for length, seq, offset in rows:
        by.setdefault(seq, []).append((offset, length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def _expand(hist, capacity):
    placements, bins = pk.plan(hist, capacity)
    rows = []
    for n, c in hist.items():
        own = [p for p in placements if p[0] == n]
        for r in range(c):
            p = [x for x in own if x[1] <= r][-1]
            rows.append((n, p[2] + (r - p[1]) // p[3], p[4] + (r - p[1]) % p[3] * n))
    assert _check(rows, capacity) == bins
    return bins


def _best_fit_decreasing(hist, capacity):
    gaps = []
    for n in sorted((n for n, c in hist.items() for _ in range(c)), reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_valid_and_as_good_as_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 64, 100])
    hist = Counter(rnd.choice([rnd.randint(1, capacity), rnd.randint(1, capacity // 2), capacity // 2]) for _ in range(rnd.randint(1, 300)))
    bins = _expand(hist, capacity)
    total = sum(n * c for n, c in hist.items())
    assert -(-total // capacity) <= bins <= _best_fit_decreasing(hist, capacity) + 1


def test_plan_of_nothing_and_of_bad_lengths():
    assert pk.plan({}, 10) == ([], 0)
    for n in (0, 11):
        with pytest.raises(ValueError):
            pk.plan({n: 1}, 10)


def test_pieces():
    assert pk.piece_lengths(5, 10) == [5] and pk.piece_lengths(10, 10) == [10]
    assert pk.piece_lengths(20, 10) == [10, 10] and pk.piece_lengths(25, 10) == [5, 10, 10]


def test_documents(spark):
    rnd = random.Random(1)
    texts = [None, "", "a", "word " * 3000, "x" * 20_000] + [" ".join(rnd.choice(["le", "the", "und", "Straße,", "x\n"]) for _ in range(rnd.randint(1, 1500))) for _ in range(120)]
    texts += [texts[9]] * 20
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)] + [(0, None, 1, "s")], "doc_id long, text string, length int, offset string")
    packed = pk.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    bins = _check([(r.length, r.sequence_id, r.offset) for r in rows], 1024)
    reference = Tokenizer.from_file(tokens.public_path(pk.TOKENIZER))
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc[0]) == 2  # the repeated row
    total = 1
    for i, t in enumerate(texts):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        if i == 0:
            continue
        assert [r.length for r in by_doc[i]] == pk.piece_lengths(len(ids), 1024)
        for k, r in enumerate(by_doc[i]):
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.piece, r.ids_crc32, bytes(r.ids)) == (k, zlib.crc32(own), own)
    assert bins <= -(-total // 1024) + 2
    whole = {r.sequence_id: bytes(r.ids) for r in pk.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == 4 * total
    assert pk.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memoised_encoder_is_exact(name):
    rnd = random.Random(4)
    reference = Tokenizer.from_file(tokens.public_path(name))
    reference.encode_special_tokens = True
    parts = ["a", "B.", "it's", "We'LL", " ", "  ", "\n", " \n ", "\t", " ", " ", "\x1c", "é", "é", "Straße,", "İ", "Σας", "12", "3.14", "x1y", "—", "日本", "<|endoftext|>", "!!", "​", "."]
    encoder = tokens.TextEncoder(tokens.public_path(name))
    for _ in range(1500):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 12)))
        assert encoder.encode(text) == np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_pack_keeps_columns_of_any_name(spark):
    names = ["length", "n", "salt", "rank", "row", "before", "place", "count", "__n"]
    docs = spark.createDataFrame([(5, i, i, i, i, i, i, i, i) for i in range(20)], ", ".join(f"`{c}` long" for c in names))
    rows = pk.pack(docs, capacity=11).collect()
    assert list(rows[0].asDict()) == [*names, "sequence_id", "offset"]
    assert sorted(r.n for r in rows) == list(range(20)) and all(r.n == r.rank == r.salt == r["count"] == r["__n"] for r in rows)
    assert _check([(r.length, r.sequence_id, r.offset) for r in rows], 11) == 10
