import zlib
from collections import Counter

from tallyglass.llm import sharding as sd


def _shards(spark, rows, n, **kw):
    schema = "doc_id long, text string, source string, shard int, __n int"
    return [r.asDict() for r in sd.shards(spark.createDataFrame(rows, schema), n, **kw).collect()]


def test_counts_slots_and_mixture(spark):
    rows = [(i, f"text é {i}" if i % 7 else None, None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 11}", 1, 2) for i in range(2003)]
    out = _shards(spark, rows, 40, order_ranges=64)
    assert sorted(r["doc_id"] for r in out) == list(range(2003))
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        raw = (rows[r["doc_id"]][1] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert set(by) == set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {r[0]: r[2] for r in rows}
    total = Counter(source.values())
    for s in range(40):
        own = Counter(source[r["doc_id"]] for r in out if r["shard"] == s)
        for name, n in total.items():
            # a shard is a run of fractional ranks whose length errs by a row for each source at most
            assert abs(own[name] - n / 40) <= 1 + n / len(rows) * len(total)


def test_same_seed_same_shards_and_ranges_do_not_matter(spark):
    rows = [(i, f"t{i}", f"s{i % 4}", 1, 2) for i in range(300)]
    key = lambda out: {r["doc_id"]: (r["shard"], r["slot"]) for r in out}
    a = key(_shards(spark, rows, 7))
    assert a == key(_shards(spark, list(reversed(rows)), 7, order_ranges=16)) and a != key(_shards(spark, rows, 7, seed=1))


def test_matches_plain_ranking(spark):
    rows = [(i, f"t{i}", f"s{i % 3}" if i % 5 else None, 1, 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, __n int")
    hashes = {r[0]: r[1] for r in df.selectExpr("doc_id", "xxhash64(0, doc_id, crc32(CAST(text AS BINARY))) & 9223372036854775807").collect()}
    ranked = []
    for s in {r[2] for r in rows}:
        # within a source: by hash range, then hash
        own = sorted((hashes[r[0]] % sd.HASH_RANGES, hashes[r[0]], r[0]) for r in rows if r[2] == s)
        ranked += [((k + 0.5) / len(own), s or "", h, i) for k, (_, h, i) in enumerate(own)]
    order = [i for *_, i in sorted(ranked)]
    want = {i: p * 9 // len(order) for p, i in enumerate(order)}
    assert {r["doc_id"]: r["shard"] for r in _shards(spark, rows, 9)} == want


def test_few_rows_repeats_and_empty(spark):
    out = _shards(spark, [(1, "a", "s", 1, 2)] * 3 + [(None, None, None, 1, 2)], 10)
    assert len(out) == 4 and len({(r["shard"], r["slot"]) for r in out}) == 4
    assert _shards(spark, [], 10) == []
