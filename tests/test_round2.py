"""Cases of files that aren't text, bursts, ranks and joins that the tables can't show."""

from pyspark.sql import functions as F

from tallyglass.functions.symbols import name_keys, name_matches
from tallyglass.operators import diagnostics, outline, refs
from tallyglass.operators.vector_search import similarity_join, top_k
from tallyglass.sources import files


def test_tree_with_binary_and_latin_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n\x00\xff\xfe")
    (tmp_path / "latin.txt").write_bytes("café Login\n".encode("latin-1"))
    (tmp_path / "b.go").write_text("func Login() {}\n")
    tree = files.tree(spark, str(tmp_path))
    assert tree.count() == 3 and files.lines(tree).count() >= 3
    assert sorted(r.path for r in refs.find(tree, "Login").collect()) == ["b.go", "latin.txt"]


def test_a_burst_begins_with_the_first_event_after_a_cut(spark):
    rows = [("u", t, k) for k, t in enumerate((0, 240, 260, 505, 2000))] + [("v", 10, 9)]
    events = spark.createDataFrame(rows, "uri string, ms long, event_id long").select("uri", F.expr("timestamp_millis(ms)").alias("ts"), "event_id")
    out = diagnostics.settle(events, 0.3, 0.25).collect()
    assert sorted((r.uri, r.n_events, r.event_id) for r in out) == [("u", 1, 4), ("u", 2, 1), ("u", 2, 3), ("v", 1, 9)]
    assert diagnostics.settle(events.limit(0), 1, 2).count() == 0


def test_the_first_quarter_is_one_of_lines(spark):
    rows = [("o", f"m{n}", n, n, "private", "method") for n in (10, 11, 12, 13)] + [("o", "Box", 100, 100, "private", "constructor")]
    out = {r.line: r.rank_score for r in outline.ranked(spark.createDataFrame(rows, "owner string, name string, line long, end_line long, visibility string, kind string")).collect()}
    assert out == {10: 0, 11: 0, 12: 0, 13: 0, 100: 4}


def test_name_keys_are_the_names_that_match(spark):
    names = ["a", "a(b)", "a(b)(c", "(x", "", "ab("]
    s = spark.createDataFrame([(n,) for n in names], "name string")
    wanted = spark.createDataFrame([(n,) for n in [*names, "ab", "a(b"]], "wanted string")
    slow = {tuple(r) for r in s.crossJoin(wanted).where(name_matches(F.col("name"), F.col("wanted"))).collect()}
    fast = {(r.name, r.wanted) for r in s.withColumn("wanted", F.explode(name_keys(F.col("name")))).join(wanted, "wanted").collect()}
    assert slow == fast


def test_similarity_join_is_a_top_k_for_each_query(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = vectors.where("id % 10 = 0")
    for block in (2, 4096):
        got = sorted(tuple(r) for r in similarity_join(vectors, queries, 5, block).collect())
        want = sorted((q, r.id, r.score) for q, v in rows if q % 10 == 0 for r in top_k(vectors, v, 5).collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want))
    assert similarity_join(vectors, queries.limit(0)).count() == 0
