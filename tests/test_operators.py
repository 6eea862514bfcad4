import random

import pytest

from tallyglass import config, render
from tallyglass.functions import ignore, text
from tallyglass.functions.languages import normalise_language, normalise_symbol_type
from tallyglass.functions.symbols import normalise_kind
from tallyglass.index import Index
from tallyglass.operators import callers, embed, extract
from tallyglass.query import ask
from tallyglass.sources import files as src
from tests.test_kernels import GO, PY

FILES = [("pkg/store.go", GO), ("pkg/a.py", PY), ("pkg/use.go", "package x\n\nfunc main() {\n\ts := New()\n\ts.Get(\"k\")\n}\n"), ("bad.py", "def ("), ("gen/out.go", "package g\n"), ("notes.md", "New things\n\n  \n")]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(p, c, len(c)) for p, c in FILES], "path string, content string, bytes long")


@pytest.mark.parametrize(
    ("pattern", "path", "path_match", "walk_match"),
    [
        ("vendor", "a/vendor/b.go", True, True), ("vendor", "vendored/b.go", False, False), ("*.log", "x/y.log", True, True), ("*.log", "x/y.log.go", False, False),
        ("gen*", "a/gen1/b.go", False, True), ("/x", "a/x/b", True, True), ("/a/b", "a/b/c", True, True), ("/a/b", "z/a/b", False, False), ("a/b", "z/a/b/c", True, True),
        ("doc_?.py", "s/doc_1.py", True, True), ("doc_?.py", "s/doc_12.py", False, False), ("src[12]", "src1", True, True), ("a.b", "aXb", False, False),
    ],
)
def test_ignore_patterns(spark, pattern, path, path_match, walk_match):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(ignore.ignored(F.col("path"), [pattern]), ignore.ignored(F.col("path"), [pattern], walk=True)).first()[:] == (path_match, walk_match)


def test_rule_set_and_fingerprint():
    rules = ignore.rule_set(["x/", "# no", "!x", "./y"], "z\nx\n")
    assert rules[-3:] == ["x", "y", "z"] and rules[0] == ".git"
    assert ignore.fingerprint(["a", "b"]) == ignore.fingerprint(["b", "a"]) != ignore.fingerprint(["a"])


def test_tree_walk(spark, tmp_path):
    for name, body in (("a/b.go", "x\ny"), ("a/vendor/c.go", "z"), ("big.py", "q" * 5000), ("r.txt", "t")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    tree = src.tree(spark, str(tmp_path))
    assert [r.path for r in src.walk(tree, ["vendor"], max_kb=2).collect()] == ["a/b.go"]
    assert [(r.line, r.snippet) for r in src.lines(tree.where("path = 'a/b.go'")).orderBy("line").collect()] == [(1, "x"), (2, "y")]


def test_scan_errors(files):
    with pytest.raises(FileNotFoundError):
        src.list_scan(files, language="rust")
    with pytest.raises(ValueError, match="more than 1"):
        src.check_scan(files, "go", limit=1)
    assert src.check_scan(files, "go").count() == 3
    for f, bad in ((normalise_language, "cobol"), (normalise_symbol_type, "thing"), (normalise_kind, "thing")):
        with pytest.raises(ValueError):
            f(bad)
    assert normalise_language(" Golang ") == "go" and normalise_symbol_type("func") == "function" and normalise_kind("TYPE") == "type"


def test_extraction(files):
    found = extract.extract(files, "Get").collect()
    assert [(r.path, r.type, r.start_line) for r in found] == [("pkg/store.go", "method", 17)] and found[0].code.startswith("func (s *Store) Get")
    with pytest.raises(LookupError):
        extract.extract(files, "Nowhere")
    assert [r.path for r in extract.warnings(files).collect()] == ["bad.py"]
    assert {r.name for r in extract.listed(files, "function").where("path = 'pkg/store.go'").collect()} == {"Get", "New"}
    summary = {r.path: r for r in extract.summary(files).collect()}
    assert summary["pkg/store.go"].symbol_counts == {"function": 1, "interface": 1, "method": 1, "struct": 1, "type": 1} and "bad.py" not in summary
    assert [r.name for r in extract.members(files, "A").orderBy("line").collect()] == ["__init__", "go", "inner"]


def test_syntax_chunks_cover_declarations_and_fall_back_to_lines(files):
    chunks = extract.syntax_chunks(files).collect()
    kinds = {(c.path, c.node_type) for c in chunks}
    assert ("pkg/store.go", "method") in kinds and ("pkg/a.py", "class") in kinds and ("bad.py", "block") in kinds and ("notes.md", "block") in kinds
    for c in chunks:
        assert c.content == "\n".join(dict(FILES)[c.path].split("\n")[c.start_line - 1 : c.end_line])
    py = [c for c in chunks if c.path == "pkg/a.py"]
    assert sorted((c.node_type, c.start_line) for c in py) == [("class", 3), ("function", 13)]  # methods are inside


def test_split_is_lossless():
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("ab\n") for _ in range(rnd.randint(0, 50)))
        parts = text.split_at_lines(t, rnd.randint(1, 12))
        assert "".join(parts) == t


class _Model:
    """Overflows beyond a limit, counts calls."""

    def __init__(self, limit):
        self.limit, self.calls = limit, 0

    def embed_batch(self, texts):
        self.calls += 1
        if max(map(len, texts)) > self.limit:
            raise embed.Overflow
        return [[float(len(t)), 1.0] for t in texts]


def test_adaptive_embedding():
    model = _Model(1024)
    e = embed.BatchEmbedder(model, 2048)
    assert e.embed(["x" * 2000, "y" * 10])[1] == [10.0, 1.0] and e.cap == 1024
    with pytest.raises(embed.Overflow):
        embed.BatchEmbedder(_Model(100), 2048).embed(["x" * 2000])
    assert [len(b) for b in embed.micro_batches(["aaa", "b", "cc", "ddddddd"], 4)] == [2, 1, 1]


def test_embed_on_executors(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(1, 200)], "id int, content string")
    out = embed.embed(df, lambda: _Model(10_000), batch=64).collect()
    assert all(list(r.vector) == [float(r.id), 1.0] for r in out) and len(out) == 199


def test_callers_depth_first_and_errors(spark):
    edges = [("alpha", "target"), ("beta", "target"), ("beta", "alpha"), ("gamma", "beta"), ("target", "gamma"), ("alpha", "target")]
    assert callers.depth_first(edges, "target", 3) == [("alpha", 1), ("beta", 1), ("gamma", 2)]
    df = spark.createDataFrame(edges, "caller string, callee string")
    roots = spark.createDataFrame([("target",)], "node string")
    assert sorted(callers.incoming(df, roots, 3).collect()) == [("alpha", 1), ("beta", 1), ("gamma", 2)]
    for f in (lambda: callers.incoming(df, roots, 0), lambda: callers.depth_first(edges, "target", 0)):
        with pytest.raises(ValueError):
            f()


def test_index_life(spark, files, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.status().first().state == "not indexed" and index.stale("c", "f")
    with pytest.raises(FileNotFoundError):
        index.chunks()
    assert index.build(files, commit="abc", patterns=["gen"])
    assert not index.build(files, commit="abc", patterns=["gen"]) and index.build(files, commit="abd", patterns=["gen"])
    meta = index.meta().first()
    assert meta.file_count == 4 and meta.chunk_count == index.chunks().count() and not index.chunks().where("path LIKE 'gen%'").count()
    assert index.status("abd", meta.ignore_fingerprint).first().state.startswith("up to date") and index.status("x").first().state.startswith("stale")
    vector = index.chunks().where("path = 'pkg/a.py'").first().vector
    hits = index.search(vector, 3, patterns=["*.md"]).collect()
    assert hits[0].score == 1.0 and [h.rank for h in hits] == list(range(1, len(hits) + 1)) and len(hits) <= 3
    assert {h.language for h in index.search(vector, 5, languages=["go"]).collect()} == {"go"}
    assert index.clear() and not index.clear()


def test_ask(spark, files):
    edges = spark.createDataFrame([("main", "Get"), ("test", "main")], "caller string, callee string")
    a = ask(files, "Get", edges=edges, depth=2)
    assert (a.mode, a.status, a.view, a.definition["path"]) == ("symbol", "ok", "body", "pkg/store.go") and not a.errors
    assert [r["path"] for r in a.sections["References"]] == ["pkg/use.go"] and [r["name"] for r in a.sections["Callers"]] == ["main", "test"]
    assert "## Definition" in a.markdown()
    assert ask(files, "Nowhere").status == "not_found_exact" and ask(files, "some words").status == "not_found"
    assert ask(files, "func {").status == "not_found" and ask(files, "pkg/a.py").status == "ok" and ask(files, "pkg/none.py").status == "not_found"
    assert ask(files, "New things").confidence == 0.5


def test_reports(spark):
    refs = spark.createDataFrame([("a.go", 3, "x()"), ("a.go", 1, "import x"), ("b.go", 2, "y()")], "path string, line int, snippet string")
    assert render.references(refs).first()[0] == "a.go (1 ref)\n  :3  x()\nb.go (1 ref)\n  :2  y()\n\n2 references found"
    rows = spark.createDataFrame([(1, "a", "f.go", 3, 1), (2, "b", "g.go", 4, 2)], "ordinal int, name string, path string, line int, depth int")
    assert render.callers(rows, "root", 2).first()[0] == "root\n  <- a (f.go:3)\n    <- b (g.go:4)\n2 callers (depth 2)"
    assert render.implementations(rows.limit(0)).first()[0] == "0 implementations found"
    hits = spark.createDataFrame([(1, "a.go", 1, 9, 0.5, "block — x")], "rank int, path string, start_line int, end_line int, score double, description string")
    assert render.search_results(hits).first()[0] == "[1] a.go:1-9 (score: 0.50)\n    block — x" and render.search_results(hits.limit(0)).first()[0] == "No results found."


def test_config_layers(tmp_path, spark):
    home, project = tmp_path / "home", tmp_path / "home/work/repo"
    (project / "deep").mkdir(parents=True)
    user = home / "user.toml"
    user.write_text("[search]\ntop_k = 5\n[store]\ncollection = 'u'\n")
    (project / config.FILE_NAME).write_text("search.top_k = 7\nbogus = 1\n")
    with pytest.warns(UserWarning, match="bogus"):
        c = config.load(project / "deep", user, {"TALLYGLASS_STORE_COLLECTION": "", "TALLYGLASS_INDEX_MAX_KB": "", "TALLYGLASS_EMBEDDING_MAX_CHARS": "9"}, home)
    assert (c.values["search.top_k"], c.sources["search.top_k"]) == (7, "project")
    assert (c.values["store.collection"], c.sources["store.collection"]) == ("", "env") and c.sources["index.max_kb"] == "default" and c.values["embedding.max_chars"] == 9
    assert [r.key for r in c.rows(spark).collect()] == sorted(config.DEFAULTS) and "search.top_k = 7 (project)" in c.lines()
    (project / ".git").mkdir()
    (project / config.FILE_NAME).unlink()
    (home / "work" / config.FILE_NAME).write_text("")
    assert config.project_file(project / "deep", home) is None
    assert config.seconds("1h30m") == 5400
    for bad in ("", "0s", "5 parsecs"):
        with pytest.raises(ValueError):
            config.seconds(bad)


def test_embed_keywords_keeps_chunks_that_lower_lengthens(spark, tmp_path):
    from tallyglass.plans import registry

    docs = [(1, "\u0130stanbul, the city and the sea", "en", "web", 31), (2, "the end", "en", "web", 7)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path.rsplit("doc_", 1)[1][0]: r.vector for r in registry.queries()["embed_keywords"](spark, str(tmp_path)).collect()}
    assert got == {"1": "10000,0,0,0,0,33", "2": "10000,0,0,0,0,100"}
