"""Identifier postings, innermost spans, set containment."""

import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.operators import containment, postings
from tallyglass.operators.enclosing import WIDE, enclosing

NAME = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+")


def plain(path, text):
    out = []
    if "\0" in text:
        return out
    for line, s in enumerate(text.split("\n"), 1):
        out += [(m[0], path, line, m.start() + 1) for m in NAME.finditer(s) if not m[0][0] in "0123456789"]
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ_9 \n.é世\U0001f600"), max_size=60), st.integers(1, 20))
def test_postings_hold_every_place(text, stretch):
    for cut in (text, text + " x", ""):
        parts = [(*p[:2], np.full(len(p[1]), f), *p[2:]) for f, t in enumerate((cut, text)) for p in postings.identifiers(t.encode(), stretch)]
        if not parts:
            continue
        tokens, often, n_files, raw = postings.coded(*(np.concatenate([p[k] for p in parts]) for k in range(5)))
        row, file, line, col = (x.tolist() for x in postings.places(raw))
        names = [t.decode() for t in tokens.to_pylist()]
        got = sorted((names[r], f, a, b) for r, f, a, b in zip(row, file, line, col, strict=True))
        want = sorted(p for f, t in enumerate((cut, text)) for p in plain(f, t))
        assert got == want and names == list(dict.fromkeys(names))
        for name, n, k in zip(names, often.tolist(), n_files.tolist(), strict=True):
            own = [p for p in want if p[0] == name]
            assert (n, k) == (len(own), len({p[1] for p in own}))


@given(st.lists(st.integers(0, 2**62), max_size=30))
def test_varints(values):
    raw, ends = postings.varints(np.array(values, np.int64))
    back, stops = postings.unvarints(raw)
    assert back.tolist() == values and stops.tolist() == ends.tolist()


def test_references_are_whole_identifiers_and_a_lookup_reads_its_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_FILES", 7)
    files = [("a.go", "func Foo() {\n  FooBar(Foo)\n}"), ("b.go", "Foo.x = foo_Foo + Foo9"), ("c.go", None), ("d.bin", "Foo\0"), ("e.go", "")] + [(f"h{i}.go", "the Foo\n" * 50) for i in range(40)]
    df = spark.createDataFrame(files, "path string, content string")
    rows = postings.build(df, str(tmp_path / "p"), buckets=4)
    found = postings.lookup(rows, ["Foo"], buckets=4)
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and re.search(r"PushedFilters: \[[^\]]*token", plan)
    want = sorted(p for path, text in files for p in plain(path, text or "") if p[0] == "Foo")
    assert sorted(tuple(r) for r in postings.named(postings.decoded(found), postings.paths_of(rows)).collect()) == want
    names, declared = spark.createDataFrame([("Foo",), (None,), ("nowhere",)], "token string"), spark.createDataFrame([("a.go", 1, "Foo")], "path string, line long, token string")
    left = postings.references(rows, names, declared, on=("path", "line", "token"), buckets=4)
    assert sorted(tuple(r) for r in left.collect()) == [p for p in want if p[1:3] != ("a.go", 1)]


def _brute(points, spans, strict=False):
    out = set()
    for path, at in set(points):
        around = [(e - s, -s, s, e, k) for p, s, e, k in spans if p == path and s is not None and (s < at < e if strict else s <= at <= e)]
        if around:
            _, _, s, e, k = min(around)
            out.add((path, at, s, e, k))
    return out


def test_innermost_span_against_brute_force_in_a_hot_file(spark):
    rng = random.Random(3)
    spans, points = [("x", None, 3, "n"), ("x", 5, 4, "backwards"), ("hot", 1, 1 << WIDE + 2, "whole")], [("x", 4), ("none", 1)]
    for path, n in (("hot", 600), ("x", 40), ("y", 5)):
        for i in range(n):
            s = rng.randint(1, 4000)
            spans.append((path, s, s + rng.choice([0, 1, 2, 7, 8, 9, 100, 1023, 1024, 1500]), f"k{i % 9}"))
        points += [(path, rng.randint(0, 5000)) for _ in range(n * 3)]
    p, s = spark.createDataFrame(points, "path string, line long"), spark.createDataFrame(spans, "path string, start_line long, end_line long, kind string")
    for strict in (False, True):
        got = enclosing(p, s, carry=["kind"], strict=strict)
        assert {tuple(r) for r in got.collect()} == _brute(points, spans, strict) and got.count() == len(_brute(points, spans, strict))
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert enclosing(p, s.limit(0)).collect() == []


def _sets(spark, rows):
    return spark.createDataFrame(rows, "set_id long, element string")


def test_containment_against_brute_force_with_hot_names(spark, monkeypatch):
    monkeypatch.setattr(containment, "KEY_PAIRS", 50)
    rng = random.Random(1)
    # Close and String are in most sets; many interfaces ask for just these
    small = [(i, e) for i in range(60) for e in rng.sample(["Close", "String", "Read", "Write", "Seek", "Rare"], rng.randint(1, 4))] + [(100 + i, "Close") for i in range(30)] + [(200, "nobody"), (200, "Close"), (201, None)]
    large = [(i, e) for i in range(80) for e in ["Close", "String"] + rng.sample(["Read", "Write", "Seek", "Rare", "x", "y"], rng.randint(0, 5))] + [(500, "Seek")] * 2
    a, b = defaultdict(set), defaultdict(set)
    for rows, own in ((small, a), (large, b)):
        for i, e in rows:
            if e is not None:
                own[i].add(e)
    want = {(i, j) for i in a for j in b if a[i] <= b[j]}
    got = [tuple(r) for r in containment.contained(_sets(spark, small), _sets(spark, large)).collect()]
    assert set(got) == want and len(got) == len(want)
    of = {r["set_id"]: r["class_id"] for r in containment.classes(_sets(spark, small).dropna().distinct()).collect()}
    assert all((of[i] == of[j]) == (a[i] == a[j]) for i in a for j in a)
    fewer = containment.contained(_sets(spark, small), _sets(spark, large), expand=False).collect()
    assert len(fewer) < len(want) and {r[0] for r in fewer} <= set(of.values())
    assert containment.contained(_sets(spark, []), _sets(spark, large)).collect() == [] == containment.contained(_sets(spark, small), _sets(spark, [])).collect()


def test_members_by_embedding_to_any_depth(spark):
    own = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("Z", "z")], "owner string, name string")
    embeds = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("D", "B"), ("D", "D"), ("Z", "Unknown")], "owner string, part string")
    got = defaultdict(set)
    for r in containment.embedded(own, embeds).collect():
        got[r["owner"]].add(r["name"])
    assert got == {"A": {"a", "b", "c", "d"}, "B": {"b", "c", "d"}, "C": {"b", "c", "d"}, "D": {"b", "c", "d"}, "Z": {"z"}}
    assert containment.embedded(own, embeds.limit(0)).count() == 5


def test_queries_have_no_nested_loops(spark):
    from tallyglass.plans import registry

    for name in ("enclosing_members", "identifier_refs", "method_sets"):
        df = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert "NestedLoop" not in df._jdf.queryExecution().toString()
        assert df.agg(F.count("*")).first()[0] > 0
