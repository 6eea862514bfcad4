"""Calls, types and reports read from source code."""

import json

import pytest

from tallyglass import render
from tallyglass.kernels import relations as rel
from tallyglass.operators import edges, extract
from tallyglass.query import ask

GO = """package x

type Reader interface {
	Read(n int) error
	Close()
}

type File struct{ n int }

func (f *File) Read(n int) error { return f.fill(n) }
func (f *File) Close()           { go func() { drop(f) }() }
func (f *File) fill(n int) error { return nil }

type Half struct{}

func (h Half) Read(n int) error { return nil }

func drop(f *File) {}
func Run() {
	f := File{}
	f.Read(1) // drop(f)
	drop(&f)
	Run()
}
"""
PY = """class Base: pass
class A(Base, mod.Other[int]):
    def go(self):
        def inner():
            return top(1)
        return self.go() or inner()
def top(x): return len(x)
print(top(2))
"""
JAVA = """class Box<T extends Comparable<T>> extends Base<T> implements Part, java.io.Closeable {
  Box() { this.fill(); }
  void fill() { if (a()) { new Helper().run(); } }
  abstract void a();
}
interface Wide extends Part, Other { }
"""
TS = "class A extends B implements C, D<E> { m() { return this.n() } n() { return 1 } }\ninterface I extends J { }\n"
CPP = "struct P : public Q, private ns::R<int> { void f() { g(1); } };\nvoid g(int a) { P p; p.f(); }\n"
RUST = "trait T { fn a(&self); }\nstruct S;\nimpl fmt::Display for S { fn fmt(&self) { self.b() } }\nimpl S { fn b(&self) { helper::<u8>(1) } }\nfn helper(a: u8) {}\n"


def _calls(text, language):
    return [(c.caller, c.callee, c.line) for c in rel.relations(text, language).calls]


def _supers(text, language):
    return [(s.name, s.parent) for s in rel.relations(text, language).supers]


def test_calls():
    assert _calls(GO, "go") == [("Read", "fill", 10), ("Close", "drop", 11), ("Run", "Read", 21), ("Run", "drop", 22), ("Run", "Run", 23)]
    assert _calls(PY, "python") == [("inner", "top", 5), ("go", "inner", 6), ("go", "go", 6), ("top", "len", 7)]
    assert _calls(JAVA, "java") == [("Box", "fill", 2), ("fill", "a", 3), ("fill", "Helper", 3), ("fill", "run", 3)]
    assert _calls(TS, "typescript") == [("m", "n", 1)]
    assert _calls(CPP, "cpp") == [("f", "g", 1), ("g", "f", 2)]
    assert [c[:2] for c in _calls(RUST, "rust")] == [("fmt", "b")]
    assert rel.relations("x", "cobol").calls == [] and rel.relations("", "go").calls == []


def test_supertypes():
    assert _supers(PY, "python") == [("A", "Base"), ("A", "Other")]
    assert _supers(TS, "typescript") == [("A", "B"), ("A", "C"), ("A", "D"), ("I", "J")]
    assert _supers(CPP, "cpp") == [("P", "Q"), ("P", "R")]
    assert _supers(RUST, "rust") == [("S", "Display")]
    assert {("Box", "Base"), ("Box", "Part"), ("Box", "Closeable"), ("Wide", "Part"), ("Wide", "Other")} <= set(_supers(JAVA, "java"))


@pytest.fixture
def files(spark):
    rows = [("a/x.go", GO), ("p.py", PY), ("B.java", JAVA), ("bad.py", "def ("), ("e.go", ""), ("n.go", None), ("r.md", "drop(f)")]
    return spark.createDataFrame([(p, c, len(c or "")) for p, c in rows], "path string, content string, bytes long")


def test_edges_over_files(spark, files):
    found = {(r.caller, r.callee): (r.path, r.line) for r in edges.call_edges(files).collect()}
    assert found["Run", "drop"] == ("a/x.go", 22) and ("top", "len") not in found and found["fill", "a"] == ("B.java", 3)
    types = {(r["super"], r["sub"]) for r in edges.type_edges(files).collect()}
    assert ("Reader", "File") in types and ("Reader", "Half") not in types and ("Base", "A") in types and ("Part", "Box") in types
    assert edges.call_edges(files.limit(0)).count() == 0 and edges.type_edges(files.limit(0)).count() == 0


def test_answer_with_callers_and_implementations(spark, files):
    a = ask(files, "drop")
    assert not a.errors and {r["name"] for r in a.sections["Callers"]} == {"Close", "Run"}
    text = a.markdown(verbose=True)
    assert text.startswith("# Symbol: `drop`\n\n## Summary\n- kind: `function`\n- file: `a/x.go`\n- view: `full_body`\n- confidence: `0.85`\n- budget: `")
    assert "## Definition (lines 18-18)\n```go\nfunc drop(f *File) {}\n```\n" in text and "- `Run` (`a/x.go:19`) reason ``" in text and text.endswith("## Meta\n- `search_chain`: `symbol`\n")
    assert a.used_lines() == 5 + 1 + 2 * len(a.sections["References"]) + 4 + 4
    b = ask(files, "Reader")
    assert [(r["name"], r["path"], r["line"]) for r in b.sections["Implementations"]] == [("File", "a/x.go", 10)] and "## Implementations (1)\n- `File` (`a/x.go:10`)\n" in b.markdown()
    none = ask(files, "Nothing").markdown()
    assert none.startswith("# No Exact Symbol: `Nothing`\nNo exact symbol named `Nothing` was found.\n") and "- `next_hint`: `retry with" in none


def test_extraction_and_summary_reports(files):
    found = extract.definitions(files, "drop").collect()
    assert render.extraction(found) == "=== file: a/x.go ===\nfunc drop(f *File) {}" and render.extraction(found, single=True) == "func drop(f *File) {}"
    one = json.loads(render.extraction(found, as_json=True, single=True))
    assert list(one) == ["name", "code", "file_path", "start_line", "end_line", "start_byte", "end_byte", "symbol_type"] and GO[one["start_byte"] : one["end_byte"]] == one["code"]
    rows = extract.summary(files.where("path IN ('p.py', 'e.go')")).collect()
    assert render.summary("d", rows) == "d  (2 files, 10 lines)\n\n  e.go 1 lines\n  p.py 9 lines    class(2) function(3)"
    assert json.loads(render.summary("d", rows, ["w"], as_json=True))["files"][1] == {"file_path": "p.py", "total_lines": 9, "symbol_counts": {"class": 2, "function": 3}}
    assert render.summary("d", []) == "d  (0 files, 0 lines)" and "\\u003c" in render.symbol_json(extract.definitions(files, "Box").collect())
