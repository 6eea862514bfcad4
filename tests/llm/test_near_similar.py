import random

import numpy as np

from tallyglass.llm import near_similar as ns
from tallyglass.llm import simhash
from tallyglass.llm import textcore as tc


def brute_groups(texts, words=5, least=0.8):
    """The first index of each text's group."""
    sets = []
    for t in texts:
        w = (t or "").encode().translate(simhash._LOWER).split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for x in s or {()}:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s or {()} for j in by[x] if j < i}:
            both = len(s & sets[j])
            if (not s and not sets[j]) or both >= least * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def _texts(rnd):
    vocab = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one two", "ONE  two", "x" * 5000]
    for _ in range(30):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(20, 300))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 4)):
            copy = list(base)
            for _ in range(rnd.randint(0, len(base) // 25 + 1)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append("\n".join(copy))
    base = [rnd.choice(vocab) for _ in range(200)]  # a large group of near copies
    for _ in range(120):
        copy = list(base)
        copy[rnd.randrange(200)] = rnd.choice(vocab)
        texts.append(" ".join(copy))
    return texts + texts[6:9]


def test_groups_match_brute_force(spark, monkeypatch):
    texts = _texts(random.Random(8))
    want = brute_groups(texts)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, node int, root string").repartition(4)
    got = {r.doc_id: r.root for r in ns.near_groups(docs).collect()}
    groups = {}
    for i, w in enumerate(want):
        groups.setdefault(w, set()).add(got[i])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)
    kept = simhash.near_dedup(docs, ns.near_groups)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def _linked(edges):
    groups = {}
    for r in ns.components(edges).collect():
        groups.setdefault(r.root, set()).add(bytes(r.node))
    return {frozenset(g) for g in groups.values()}


def _name(i):
    return i.to_bytes(16, "big")


def test_wide_masks_match_popcounts():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**64, (150, 8), dtype=np.uint64)
    prints[75:] = prints[:75]
    prints[75:, 0] ^= rng.integers(0, 2**64, 75, dtype=np.uint64)
    prints[75:, 1] ^= rng.integers(0, 2**20, 75, dtype=np.uint64)
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    planes, valid = simhash.bit_planes(np.concatenate((prints, prints[:42]))), np.array([2**64 - 1, 2**64 - 1, 2**22 - 1], np.uint64)
    for radius in (0, 1, 2, 7, 8, 30, 33, 40, 150, 256, 511):
        masks = simhash.near_masks(np.repeat(prints, 3, axis=0), np.tile(np.arange(3), 150), planes, valid, radius)
        near = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(150, -1), axis=1, bitorder="little")
        assert (near[:, :150].astype(bool) == (distance <= radius)).all() and not near[:, 150:].any(), radius


def test_hot_key_in_chunks(spark):
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**64, (50, 8), dtype=np.uint64)
    prints[1::2] = prints[::2] ^ np.uint64(1)
    near = {frozenset({_name(i), _name(i + 1)}) for i in range(0, 50, 2)}
    keyed = spark.createDataFrame([(_name(i), 7) for i in range(50)] + [(_name(0), 8)], "node binary, key long")
    sketches = spark.createDataFrame([(_name(i), prints[i].tobytes()) for i in range(50)], "node binary, sketch binary")
    for hot in (10, 2048):
        assert _linked(ns.near_edges(keyed, sketches, hot_key=hot)) == near


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert len({r.root for r in ns.near_groups(docs).collect()}) == 2
    assert ns.near_groups(docs.limit(0)).count() == 0


def _hash(values):
    return np.unique(tc.mix(np.array(list(values), np.uint64)))


def _brute_links(nodes, least=0.8):
    """The components of (node, set), as a set of frozensets of two nodes or more."""
    root = {n: n for n, _ in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (n, x) in enumerate(nodes):
        for m, y in nodes[:i]:
            if len(x & y) >= least * len(x | y):
                root[find(n)] = find(m)
    groups = {}
    for n, _ in nodes:
        groups.setdefault(find(n), set()).add(_name(n))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_verified_links_match_brute_force_in_any_cells(spark):
    rnd = random.Random(4)
    nodes = []
    for i in range(500):  # near the limit on both sides, of three templates, and some alone
        base = i % 3 * 1000
        nodes.append((i + 1, (set(range(base, base + 60)) - set(rnd.sample(range(base, base + 60), rnd.randint(0, 9)))) | {rnd.randrange(10**6, 10**7) for _ in range(rnd.randint(0, 6))}))
    nodes += [(i, {rnd.randrange(10**6, 10**7) for _ in range(20)}) for i in range(900, 930)]
    want = _brute_links(nodes)
    assert len(want) > 2
    sets = spark.createDataFrame([(_name(n), ns.sketch(_hash(s)).tobytes(), _hash(s).tobytes()) for n, s in nodes] * 2, "node binary, sketch binary, shingles binary").repartition(3)
    groups = spark.createDataFrame([(_name(n), _name(1 if n < 915 else 2)) for n, _ in nodes], "node binary, root binary")
    for cell_bytes in (8 << 20, 60_000, 12_000):
        found = {}
        for r in ns.verified_components(sets, groups, cell_bytes=cell_bytes).collect():
            found.setdefault(bytes(r.root), set()).add(bytes(r.node))
        assert {frozenset(g) for g in found.values()} == want, cell_bytes


def test_near_copies_around_the_limit_match_brute_force(spark):
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(220)]
    texts = []
    for _ in range(500):
        copy = list(base)
        for at in rnd.sample(range(220), rnd.randint(2, 7)):
            copy[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"y{rnd.randrange(50)}" for _ in range(n)) for n in (6, 7, 8, 9) for _ in range(40)]
    texts += [t + " more" for t in texts[500:560]]
    want = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.root for r in ns.near_groups(docs).collect()}
    assert len(set(got.values())) == len(set(want)) and len({(got[i], w) for i, w in enumerate(want)}) == len(set(want))


def test_pairs_at_the_limit_pass_the_radius():
    rng = np.random.default_rng(9)
    worst = 0
    for common, more in ((4, 1), (8, 2), (8, 1), (40, 10), (400, 100)):
        for _ in range(300):
            all_ = rng.integers(0, 2**63, common + more, dtype=np.uint64)
            a, b = all_[: common + more // 2], np.concatenate((all_[:common], all_[common + more // 2 :]))
            worst = max(worst, int(np.bitwise_count(ns.sketch(np.sort(a)) ^ ns.sketch(np.sort(b))).sum()))
    assert worst <= ns.RADIUS - 10
