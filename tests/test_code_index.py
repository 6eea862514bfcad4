import pytest

from tallyglass.code_index import TABLES, CodeIndex
from tallyglass.operators import postings
from tallyglass.query import ask
from tallyglass.segments import Conflict, SegmentLog, State

GO = """package a

type Reader interface {
	Read() int
}

type ReadCloser interface {
	Reader
	Close()
}

type Base struct{ n int }

func (b *Base) Read() int { return fill(b) }

type File struct {
	*Base
	name string
}

func (f *File) Close() { drop(f) }

type Half struct{}

func (h Half) Close() {}

func fill(b *Base) int { return 1 }
"""
USE = "package b\n\nfunc Run(f *File) {\n\tfillAll := f.Read()\n\tfill(f.Base)\n\t_ = fillAll\n}\n\nfunc drop(f *File) { fill(nil) }\n"


def _files(spark, rows):
    return spark.createDataFrame([(p, c, len((c or "").encode())) for p, c in rows], "path string, content string, bytes long")


def _tables(index):
    out = {t: sorted(repr(r) for r in index.rows(t).collect()) for t in TABLES if t != "postings"}
    rows = index._postings()
    return out | {"postings": sorted(repr(r) for r in postings.named(postings.decoded(rows), postings.paths_of(rows)).collect())}


def test_changes_deletions_and_compaction_equal_a_rebuild(spark, tmp_path):
    first = [("a/x.go", GO), ("b/use.go", USE), ("p.py", "def top():\n    return len([])\n"), ("n.md", None), ("old.go", "package o\n\nfunc Old() {}\n")]
    then = [("a/x.go", GO.replace("fill", "load")), ("b/use.go", USE), ("p.py", "def top():\n    return len([])\n"), ("n.md", "Read the docs"), ("new.go", "package o\n\nfunc Fresh() { fill(nil) }\n")]
    index = CodeIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.update(_files(spark, first), batch="1") == {"changed": 5, "deleted": 0}
    before = _tables(index)
    # the same again, and a batch played twice, change nothing
    assert index.update(_files(spark, first)) == {"changed": 0, "deleted": 0} and len(index.log.state().segments) == 1
    assert index.update(_files(spark, then), batch="1") == {"changed": 0, "deleted": 0} and _tables(index) == before
    assert index.update(_files(spark, then), batch="2") == {"changed": 3, "deleted": 1}
    rebuilt = CodeIndex(spark, str(tmp_path / "r"), buckets=4)
    rebuilt.update(_files(spark, then))
    assert _tables(index) == _tables(rebuilt) != before
    index.compact()
    assert len(index.log.state().segments) == 1 and _tables(index) == _tables(rebuilt) and index.log.state().batches == ["1", "2"]
    assert index.update(_files(spark, then[:1]), whole=False) == {"changed": 0, "deleted": 0}
    assert index.update(_files(spark, []), whole=False, deleted=_files(spark, then[1:2])) == {"changed": 0, "deleted": 1}
    assert not any("b/use.go" in r for r in _tables(index)["postings"])


def test_an_update_that_fails_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = CodeIndex(spark, str(tmp_path / "i"), buckets=4)
    index.update(_files(spark, [("a/x.go", GO)]))
    before = _tables(index)
    with monkeypatch.context() as m:
        m.setattr(index.log, "commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.update(_files(spark, [("a/x.go", USE)]), batch="x")
    assert _tables(index) == before
    assert index.update(_files(spark, [("a/x.go", USE)]), batch="x") == {"changed": 1, "deleted": 0} and _tables(index) != before
    assert index.log.vacuum()  # what the failed update had written


def test_two_writers_conflict(spark, tmp_path):
    a, b = SegmentLog(spark, str(tmp_path / "s")), SegmentLog(spark, str(tmp_path / "s"))
    old = b.state()
    assert a.commit(State(0, ["x"], [])).version == 1
    with pytest.raises(Conflict):
        b.commit(old)
    assert b.state().segments == ["x"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files = _files(spark, [("a/x.go", GO), ("b/use.go", USE), ("c/other.go", "package c\n\nfunc fill() {}\n")])
    out = CodeIndex(spark, str(tmp_path_factory.mktemp("code") / "i"), buckets=4)
    out.update(files)
    return files, out


def test_references_are_identifiers_and_know_what_is_around_them(index):
    _, ix = index
    got = {(r["path"], r["line"], r["name"]) for r in ix.referrers(["fill"]).collect()}
    assert got == {("a/x.go", 14, "Read"), ("b/use.go", 5, "Run"), ("b/use.go", 9, "drop")}
    assert {r["path"] for r in ix.references(["fill"], scope="a").collect()} == {"a/x.go"}


def test_implementations_by_embedding(index):
    _, ix = index
    edges = {(r["super"], r["sub"]) for r in ix.type_edges().collect()}
    # File has Read by embedding Base, and ReadCloser asks for it by embedding Reader
    assert edges == {("Reader", "Base"), ("Reader", "File"), ("ReadCloser", "File")}


def test_answers_from_the_index_parse_nothing(spark, index, monkeypatch):
    files, ix = index
    from tallyglass.operators import edges, extract

    for module, name in ((extract, "_parse"), (edges, "_related")):
        monkeypatch.setattr(module, name, lambda *a: pytest.fail("parsed"))
    a = ask(files, "fill", index=ix)
    assert not a.errors and a.definition["path"] == "a/x.go" and [r["path"] for r in a.sections["Other definitions"]] == ["c/other.go"]
    assert {r["path"] for r in a.sections["References"]} == {"a/x.go", "b/use.go"} and {r["name"] for r in a.sections["Callers"]} == {"Read", "Run", "drop"}
    assert ask(files, "fill", index=ix, scope="c").definition["path"] == "c/other.go"
    b = ask(files, "Reader", index=ix)
    assert not b.errors and {r["name"] for r in b.sections["Implementations"]} == {"Base", "File"} and "## Implementations (2)" in b.markdown()


def test_all_other_definitions_are_kept(spark):
    files = _files(spark, [(f"d{i:02}.go", "package d\n\nfunc Same() {}\n") for i in range(12)])
    a = ask(files, "Same")
    assert not a.errors and len(a.sections["Other definitions"]) == 11 == a.tables["Other definitions"].count() and "## Other Definitions (11)" in a.markdown()
