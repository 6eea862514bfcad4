import re
from collections import Counter, defaultdict

import pytest

from tallyglass.llm import mixing as mx

SCHEMA = "doc_id long, text string, source string, size int, copies string"


def wanted(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess round by round, in plain Python."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {s: 0.0 for s in sizes}, set(sizes)
    while open_:
        left = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        target.update({s: float(most * sizes[s]) if s in full else share[s] for s in open_})
        if not full:
            break
        open_ -= full
    return target


def run(spark, rows, **options):
    return mx.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()


def held(rows, out, most=3):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += count(text)
    target = wanted(sizes, most=most)
    source = {r[0]: r[2] for r in rows}
    taken, largest = Counter(), Counter()
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * (1 + target[s])
        e = target[s] / sizes[s] if sizes[s] else 0
        assert int(e) <= r["copies"] <= min(most, int(e) + 1)
        taken[s] += r["copies"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, count(t)) for i, t, *_ in rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s], s
    return taken, target


def _rows(n):
    return [(i, "w " * (i * 7919 % 97) + "é x\t\x1c", None if i % 9 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}", 1, "c") for i in range(n)]


@pytest.mark.parametrize("range_rows", [mx.RANGE_ROWS, 20])
def test_targets_and_nearness(spark, range_rows):
    rows = _rows(1500)
    taken, target = held(rows, run(spark, rows, range_rows=range_rows))
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)


def test_every_law_of_systematic_sampling_against_plain_ranks(spark):
    """Copies are those of one prefix sum a source, whatever the ranges."""
    rows = _rows(400)
    key = lambda out: {(r["doc_id"], r["copies"]) for r in out}
    first = run(spark, rows)
    assert key(first) == key(run(spark, list(reversed(rows)), range_rows=7))
    assert key(first) != key(run(spark, rows, seed=1))
    import hashlib

    by = defaultdict(list)
    for i, text, source, *_ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        step = size if size < 32 else (size.bit_length() - 5) * 16 + (size >> (size.bit_length() - 5))
        by[source].append((step, hashlib.md5(f"0:{i}:{text}".encode()).hexdigest(), i, size))
    copies = {r["doc_id"]: r["copies"] for r in first}
    target = {r["doc_id"]: r["target"] for r in first}
    for source, own in by.items():
        own.sort()
        total = sum(r[3] for r in own)
        e, u = target[own[0][2]] / total, (int(hashlib.md5(f"0:{source or ''}".encode()).hexdigest()[:3], 16) + 0.5) / 4096
        tried = []
        for k in range(mx.OFFSETS):
            v = (u + k / mx.OFFSETS) % 1
            mine = [int((j + 1) * e + v) - int(j * e + v) for j in range(len(own))]
            tried.append((abs(sum(m * r[3] for m, r in zip(mine, own, strict=True)) - e * total), k, mine))
        assert [copies[r[2]] for r in own] == min(tried)[2]


def test_full_sources_reshare_in_rounds(spark):
    rows = [(i, "w " * 10, "a", 0, "") for i in range(3)] + [(10 + i, "w " * 40, "b", 0, "") for i in range(5)] + [(100 + i, "w " * 50, "c", 0, "") for i in range(100)]
    taken, target = held(rows, run(spark, rows))
    assert taken["a"] == target["a"] == 90 and taken["b"] == target["b"] == 600


def test_nulls_empty_repeats_and_long(spark):
    rows = [(1, None, "a", 0, ""), (None, "x y", None, 0, ""), (2, "", "b", 0, ""), (3, "w " * 200_000, "c", 0, "")] + [(4, "same text", "c", 0, "")] * 50
    out = run(spark, rows)
    assert len(out) == len(rows) and all(0 <= r["copies"] <= 3 for r in out)
    assert {r["target"] for r in out if r["doc_id"] in (1, 2)} == {0.0}
    assert run(spark, []) == []
    assert {r["copies"] for r in run(spark, [(1, None, None, 0, ""), (2, " ", "a", 0, "")])} == {0}


def test_mixture_repeats_whole_rows(spark):
    rows = _rows(200)
    copies = {r["doc_id"]: r["copies"] for r in run(spark, rows)}
    out = mx.mixed(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == [*SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", "), "mix_copy"]
    got = Counter(tuple(r)[:5] for r in out.collect())
    assert got == Counter({r: copies[r[0]] for r in rows if copies[r[0]]})


def test_words_across_stretches():
    for text in ("", " ", "a", " a b\tc ", "ab cd\x1cef \x0b"):
        for stretch in (1, 2, 3, 100):
            assert mx.n_words(text.encode(), stretch) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
