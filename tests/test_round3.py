import random

from pyspark.sql import functions as F

from tallyglass.functions import paths, text
from tallyglass.plans import registry


def test_split_sizes_are_those_of_split_at_lines(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab\n" if i % 2 else "abcdefgé\n") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, "x" * 10), (901, "x" * 9 + "\n"), (902, "x" * 25 + "\n\n"), (903, "a\n" + "x" * 10), (904, None)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", text.split_sizes(F.col("t"), 10).alias("p")).collect()
    own = dict(rows)
    for r in got:
        if own[r["i"]]:
            assert [own[r["i"]][s : s + n] for s, n in r["p"]] == text.split_at_lines(own[r["i"]], 10), repr(own[r["i"]])


def test_uris_round_trip(spark):
    rows = [("/a b/c+d.go",), ("/ä/世%41#?.py",), ("/plain/x_1-2.~(3)",), (None,), ("relative",)]
    df = spark.createDataFrame(rows, "p string").select("p", paths.path_to_uri(F.col("p")).alias("u"))
    out = df.select("p", "u", paths.uri_to_path(F.col("u")).alias("back")).collect()
    assert all(r["p"] == r["back"] for r in out)
    assert out[0]["u"] == "file:///a%20b/c+d.go" and out[2]["u"] == "file:///plain/x_1-2.~(3)"
    odd = spark.createDataFrame([("file:///a+b%20c",), ("http://x/%20",), ("file:///bad%zz",), ("file:///%C3%A4",)], "u string").select(paths.uri_to_path(F.col("u"))).collect()
    assert [r[0] for r in odd] == ["/a+b c", "http://x/%20", "file:///bad%zz", "/ä"]


def test_nearest_roots(spark):
    files = spark.createDataFrame([("a/b/c/x.go",), ("a/y.go",), ("z.go",), ("q/w/e.go",)], "path string")
    marks = spark.createDataFrame([("a",), ("a/b",), ("a/b",), (None,)], "dir string")
    assert {tuple(r) for r in paths.nearest_roots(files, marks).collect()} == {("a/b/c/x.go", "a/b"), ("a/y.go", "a"), ("z.go", "."), ("q/w/e.go", "q/w")}


def test_every_query_reads_a_table(spark):
    for name, query in registry.queries().items():
        if name in ("ivf_search", "ivf_search_all_lists", "identifier_refs", "identifier_counts", "identifier_lookup", "ask_batch", "method_sets", "document_word_sets", "receiver_join") or name.startswith("callers") or name == "score_callers":
            continue  # these store what they have read
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan, name
