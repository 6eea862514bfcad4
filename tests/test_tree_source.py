import os

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tallyglass.sources import files, tree_source

PATTERNS = ["node_modules", "*.gen.go", "/lib/private"]


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "tree"
    for path, text in {
        "a.go": "package a", "b.txt": "no", "src/x.go": "package x\n", "src/x.gen.go": "made", "src/deep/er/y.py": "y = 1", "src/deep/er/Z.PY": "z",
        "node_modules/m/i.js": "no", "src/node_modules/j.js": "no", "lib/private/k.go": "no", "lib/public/k.go": "k" * 3000, "other/lib/private/l.go": "l", "empty.go": "",
    }.items():
        os.makedirs(at / os.path.dirname(path), exist_ok=True)
        (at / path).write_text(text)
    (at / "src/latin.go").write_bytes(b"caf\xe9 \xff\xfe\n")
    os.symlink(at / "src", at / "loop")
    return str(at)


def _listed(monkeypatch, root, filters=(), **options):
    """Paths that the reader gives, what it hands back of the filters, and the directories it lists."""
    seen = []
    scan = os.scandir
    monkeypatch.setattr(tree_source.os, "scandir", lambda p: (seen.append(os.path.relpath(p, root)), scan(p))[1])
    reader = tree_source.TreeSource({"path": root, "patterns": "\n".join(PATTERNS), **options}).reader(None)
    back = list(reader.pushFilters(list(filters)))
    paths = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("path").to_pylist()]
    monkeypatch.undo()
    assert len(paths) == len(set(paths))
    return sorted(paths), back, set(seen)


def test_equals_walk(spark, root):
    for patterns, kb in (((), 0), (PATTERNS, 0), (PATTERNS, 2)):
        # Spark's own listing follows links and leaves out empty files
        want = files.walk(files.tree(spark, root), patterns, max_kb=kb).where(~F.col("path").startswith("loop/")).select("path", "content", "bytes").collect()
        want = sorted([*want, ("empty.go", "", 0)])
        got = tree_source.read_tree(spark, root, patterns, max_kb=kb).orderBy("path").collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert len(got) == 7


def test_ignored_directories_are_not_listed(monkeypatch, root):
    for split in ("1", "2", "100"):
        paths, _, seen = _listed(monkeypatch, root, split=split)
        assert paths == sorted(["a.go", "empty.go", "src/x.go", "src/latin.go", "src/deep/er/y.py", "src/deep/er/Z.PY", "lib/public/k.go", "other/lib/private/l.go"])
        assert seen == {".", "src", "src/deep", "src/deep/er", "lib", "lib/public", "other", "other/lib", "other/lib/private"}


def test_filters_prune_directories(monkeypatch, root):
    paths, back, seen = _listed(monkeypatch, root, [ds.StringStartsWith(("path",), "src/de"), ds.StringContains(("path",), "y")])
    assert paths == ["src/deep/er/Z.PY", "src/deep/er/y.py"] and back == [ds.StringContains(("path",), "y")]
    assert seen == {".", "src", "src/deep", "src/deep/er"}
    paths, back, seen = _listed(monkeypatch, root, [ds.In(("path",), ("a.go", "lib/public/k.go")), ds.LessThan(("bytes",), 100)])
    assert (paths, back, seen) == (["a.go"], [], {".", "lib", "lib/public"})


def test_filters_reach_the_source_through_spark(spark, root):
    df = tree_source.read_tree(spark, root, PATTERNS, content=False)
    got = df.where(F.col("path").startswith("src/") & (F.col("bytes") > 5) & F.col("path").contains(".")).select("path").collect()
    assert sorted(r.path for r in got) == ["src/latin.go", "src/x.go"]
    assert df.columns == ["path", "bytes"]


def test_missing_root(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        tree_source.read_tree(spark, str(tmp_path / "nowhere")).collect()
