"""Findings of round 3: what grew faster than its input."""

import pyarrow as pa

from tallyglass.operators import containment, extract, postings
from tallyglass.operators.enclosing import enclosing
from tests.test_structure import plain


def test_symbols_of_a_page_of_one_line_take_no_copies_of_it(spark):
    page = "<div>" + "<p>é" * 2000 + "</div>"
    found = extract._parse.func(pa.array([page, None, "<a>\n</a>"] * 200), pa.array(["html"] * 600))
    assert found.nbytes < 100 * 200 * len(page) / 5 and len(found) == 600
    assert [len(x["symbols"]) for x in found.slice(597).to_pylist()] == [2001, 0, 1]
    files = [("a.html", page[:30] + "</div>\nx"), ("b.py", "class A:\n  def f(self):  \t\n    pass\n"), ("c.go", "package c\n\nfunc F() {\r\n}\n"), ("d.py", "def (")]
    rows = extract.exploded(spark.createDataFrame(files, "path string, content string"))
    got = {(r["path"], r["name"], r["start"]): r["signature"] for r in rows.collect()}
    assert got[("a.html", "div", 0)] == page[:30] + "</div>" and got[("a.html", "p", 5)] == page[5:30] + "</div>"
    assert {got[k] for k in got if k[0] != "a.html"} == {"class A:", "def f(self):", "func F() {"}
    assert "signature" not in extract.exploded(spark.createDataFrame(files, "path string, content string")).select("name")._jdf.queryExecution().optimizedPlan().toString()


def test_a_summary_is_one_pass_without_a_shuffle(spark):
    files = [("a.html", "<p><b>x</b><script>1</script>\n<br>"), ("b.html", ""), ("c.html", None), ("d.py", "def ("), ("e.txt", "<p>"), ("f.java", "class A {\n  A() {}\n  void f() {}\n}\n")]
    df = spark.createDataFrame(files, "path string, content string")
    found = extract.summary(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    got = {r["path"]: r["symbol_counts"] for r in found.collect()}
    want = {p: {} for p in ("a.html", "b.html", "c.html", "f.java")}
    for r in extract.listed(df).groupBy("path", "type").count().collect():
        want[r["path"]][r["type"]] = r["count"]
    assert got == want and got["a.html"] == {"element": 3, "script": 1}
    assert extract.listed(df)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_definitions_are_ordered_without_their_files(spark):
    files = [("b.html", "<p>x<div><div>é</div></div>"), ("a.html", "<div a>\n<div></div>"), ("c.html", None), ("d.html", "<p>")]
    df = spark.createDataFrame(files, "path string, content string")
    found = extract.definitions(df, "div")
    assert [(r["path"], r["start"], r["code"], r["signature"]) for r in found.collect()] == [("a.html", 0, "<div a>\n<div></div>", "<div a>"), ("b.html", 4, "<div><div>é</div></div>", "<div><div>é</div></div>")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("content#") and extract.definitions(df, "none").collect() == []
    assert extract.definitions(spark.createDataFrame(files[:1] * 2, "path string, content string"), "div").count() == 1


def test_places_and_spans_are_shuffled_once(spark):
    rows = [("x", 5, 5, "a"), ("x", 1, 1030, "b"), ("x", 1000, 1030, "c"), (None, 1, 9, "n"), ("y", -5, 3, "d")]
    spans = spark.createDataFrame(rows, "path string, start_line int, end_line int, kind string")
    points = spark.createDataFrame([("x", 5), ("x", 5), ("x", 1024), ("x", 1031), ("y", -5), ("y", None), (None, 5)], "path string, line long")
    want = {("x", 5, 5, 5, "a"), ("x", 1024, 1000, 1030, "c"), ("y", -5, -5, 3, "d")}
    assert {tuple(r) for r in enclosing(points, spans, carry=["kind"]).collect()} == want
    short = enclosing(points, spans.where("kind <> 'b'"), carry=["kind"])
    assert {tuple(r) for r in short.collect()} == want
    plan = short._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2


def test_references_of_many_names_shuffle_no_place(spark, monkeypatch):
    files = [("a.go", "1 Foo(Bar) Foo\nBar"), ("b.go", "Bar é_世 Foo"), ("c.go", "é_世\n" * 3000 + "x Foo"), ("d.bin", "Bar\0"), ("e.go", None), ("f.go", "9 .")]
    df = spark.createDataFrame(files, "path string, content string")
    assert sorted(r[0] for r in postings.firsts(df).collect()) == ["Bar", "Foo", "é_世"]
    want = [p for path, text in files for p in plain(path, text or "")]
    seen = set()
    want = sorted(p for p in want if p[0] in ("Foo", "Bar", "é_世") and (p[1] in seen or seen.add(p[1])))
    for size in (4 << 20, 3):
        found = postings.scan(df, postings.firsts(df), slice_bytes=size)
        assert sorted(tuple(r)[:4] for r in found.where("nth > 0").collect()) == want
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(postings, "BLOCK_BYTES", 50)
    monkeypatch.setattr(postings.identifiers, "__defaults__", (64,))
    raw = pa.RecordBatch.from_pydict({"path": [p for p, _ in files], "content": [(t or "").encode() for _, t in files]})
    got = [r for b in postings._scanner(type("B", (), {"value": {n.encode() for n in ("Foo", "Bar", "é_世")}}))(iter([raw])) for r in b.to_pylist()]
    assert sorted((r["token"], r["path"], r["line"], r["col"]) for r in got if r["nth"]) == want
    assert postings.scan(df, postings.firsts(df.limit(0))).collect() == []


def test_containment_frees_shuffles_as_it_goes(spark, monkeypatch):
    name, seen, stored = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], containment.stored
    monkeypatch.setattr(containment, "stored", lambda *a: (seen.append((a[1], spark.conf.get(name))), stored(*a))[1])
    before = spark.conf.get(name)
    small = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "a"), (3, "b"), (4, "x"), (5, None)], "set_id long, element string")
    large = spark.createDataFrame([(7, "a"), (7, "b"), (7, "c"), (8, "a"), (8, "b"), (9, "c")], "set_id long, element string")
    assert sorted(tuple(r) for r in containment.contained(small, large).collect()) == [(1, 7), (2, 7), (2, 8), (3, 7), (3, 8)]
    assert {on for _, on in seen} == {"true"} and "set-candidates" in dict(seen) and spark.conf.get(name) == before
