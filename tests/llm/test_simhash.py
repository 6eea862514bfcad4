import random

import numpy as np
import xxhash

from tallyglass.llm import simhash as sh
from tallyglass.llm.graph import components
from tallyglass.llm.xx64 import xxh64


def brute_fp(text, k=3):
    words = (text or "").encode().translate(sh._LOWER).split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_vector_hash_is_xxh64():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(5000))
    starts = np.array([rnd.randrange(4000) for _ in range(2000)])
    ends = starts + np.array([rnd.randrange(0, 200) for _ in range(2000)])
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(starts, ends)]


def test_operator_matches_brute_force(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n", "One", "one", "one two", "One  Two", "x" * 5000]
    base = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 9) for _ in range(rnd.randint(1, 400))) for _ in range(40)]
    texts += base + base[:5] + [b + " z" for b in base[5:25]] + [" ".join(str(i) for i in range(40_000))]
    docs = spark.createDataFrame([(i + 7, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp int, root int").repartition(3)
    fps = [brute_fp(t) for t in texts]
    comp = brute_components(fps)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in sh.near_groups(docs).collect()}
    assert got == {i + 7: (fps[i], comp[i] + 7) for i in range(len(texts))}
    kept = sh.near_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c + 7 for c in comp}) and kept.columns == docs.columns


def test_all_links_are_found_also_in_hot_keys(spark):
    rnd = random.Random(3)
    fps = {0, 1, 3, (1 << 64) - 1}
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.add(f)
        for _ in range(rnd.randint(0, 12)):
            f ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(20)) for _ in range(150)}
    fps = sorted(fps)
    comp = brute_components(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for hot in (4096, 20):
        found = {r.node & (1 << 64) - 1: r.root for r in components(sh.fingerprint_edges(df, hot_key=hot)).collect()}
        groups = {}
        for f, c in zip(fps, comp):
            groups.setdefault(c, set()).add(f)
        for g in groups.values():
            assert len({found.get(f) for f in g}) == 1
        assert len({v for v in found.values()}) == sum(len(g) > 1 for g in groups.values())


def test_components_of_chains_and_empty(spark):
    n = 300
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (2000, 2001), (2001, 2000)], "u long, v long")
    out = {r.node: r.root for r in components(chain).collect()}
    assert out == {**{i: 0 for i in range(n + 1)}, 2000: 2000, 2001: 2000}
    assert components(chain.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (None, "other words now"), (None, None)], "doc_id long, text string")
    assert sh.near_groups(docs).count() == 4
    assert sorted((r.doc_id or -1) for r in sh.near_dedup(docs).collect()) == [-1, -1, 1]
    assert sh.near_dedup(docs.limit(0)).count() == 0


def test_rows_pass_whole(spark):
    docs = spark.createDataFrame([(1, "two", 5, "x", 7), (2, "two", 5, "x", 7)], "doc_id long, text string, __hash int, row string, `a.b` int")
    out = sh.near_dedup(docs)
    assert out.columns == docs.columns and out.collect() == docs.collect()[:1]
