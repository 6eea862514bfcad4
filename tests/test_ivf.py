import numpy as np
import pytest

from tallyglass.operators.ivf import IvfIndex, fit
from tallyglass.operators.vector_search import similarity_join

SF = "/root/testdata/sf0.01"


def _exact(vectors, queries, k):
    unit = lambda x: x / (np.linalg.norm(x) or 1.0)
    out = set()
    for q, v in queries:
        scored = sorted((-round(float(unit(v) @ unit(w)), 6) + 0.0, i) for i, w in vectors)
        out |= {(q, i, -s) for s, i in scored[:k]}
    return out


def _rows(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def _got(df):
    rows = [(r["query_id"], r["id"], r["score"]) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return {(q, i, round(s, 6) + 0.0) for q, i, s in rows}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    return vectors, IvfIndex(spark, str(tmp_path_factory.mktemp("ivf") / "i")).build(vectors)


def test_recall_at_the_default_and_exact_with_all_lists(spark, index):
    vectors, ivf = index
    asked = vectors.where("id % 20 = 0")
    exact = _got(similarity_join(vectors, asked, 10))
    plain = [(r["id"], np.array(r["vector"], float)) for r in vectors.collect()]
    # rounded scores may tie, so ids are compared with their scores
    assert exact == _exact(plain, [(i, v) for i, v in plain if i % 20 == 0], 10)
    assert _got(ivf.search(asked, 10, n_probes=10_000)) == exact
    near = _got(ivf.search(asked, 10))
    assert len(near & exact) / len(exact) >= 0.9
    assert len(near) == len(exact)


def test_one_hot_list_of_equal_vectors_ties_and_zeros(spark, tmp_path, monkeypatch):
    from tallyglass.operators import ivf as module

    monkeypatch.setattr(module, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(0)
    rows = [(i, np.array([1.0, 2.0, 3.0])) for i in range(700)] + [(1000 + i, rng.normal(size=3)) for i in range(300)] + [(5000, np.zeros(3))]
    ivf = IvfIndex(spark, str(tmp_path / "hot")).build(_rows(spark, rows), n_lists=9)
    assert ivf.lists().select("list", "split").distinct().count() > 9
    asked = rows[:2] + rows[750:760] + [rows[-1]]
    got = _got(ivf.search(_rows(spark, asked), 7, n_probes=9))
    stored = [(i, np.float32(v).astype(float)) for i, v in rows]
    want = _exact(stored, [(i, np.float32(v).astype(float)) for i, v in asked], 7)
    score = lambda rows: sorted((q, s) for q, _, s in rows)
    assert score(got) == score(want)
    assert {i for q, i, _ in got if q in (0, 1)} == set(range(7))
    assert _got(similarity_join(_rows(spark, rows), _rows(spark, asked), 7, split_rows=100)) == got


def test_append_null_vectors_and_empty(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8)) for i in range(200)]
    ivf = IvfIndex(spark, str(tmp_path / "a")).build(_rows(spark, rows[:150]))
    ivf.append(_rows(spark, rows[150:]))
    whole = _got(similarity_join(_rows(spark, rows), _rows(spark, rows[::20]), 5))
    assert _got(ivf.search(_rows(spark, rows[::20]), 5, n_probes=999)) == whole
    with_null = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<float>")
    one = IvfIndex(spark, str(tmp_path / "n")).build(with_null)
    assert _got(one.search(with_null, 5)) == {(1, 1, 1.0)}
    empty = IvfIndex(spark, str(tmp_path / "e")).build(with_null.limit(0))
    assert empty.search(with_null, 5).collect() == [] and one.search(with_null.limit(0), 5).collect() == []


def test_text_ids(spark, tmp_path):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<float>")
    got = IvfIndex(spark, str(tmp_path / "t")).build(rows).search(rows, 2, n_probes=9)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "c"), ("c", "a")}


def test_quantiser_keeps_empty_centres():
    centres = fit(np.array([[1.0, 0.0]] * 5 + [[0.0, 1.0]]), 4)
    assert centres.shape == (4, 2) and np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_an_index_with_inverted_lists(spark, tmp_path):
    from tallyglass.index import Index

    rows = [(f"pkg/f{i}.go", f"package p\n\nfunc F{i}() {{ error index search {'auth ' * (i % 7)} }}\n") for i in range(30)]
    files = spark.createDataFrame([(p, c, len(c)) for p, c in rows], "path string, content string, bytes long")
    index = Index(spark, str(tmp_path / "index"))
    assert index.build(files, commit="a", ivf=True)
    vector = index.chunks().where("path = 'pkg/f3.go'").first().vector
    exact = [(r["path"], r["score"]) for r in index.search(vector, 5).collect()]
    assert [(r["path"], r["score"]) for r in index.search(vector, 5, n_probes=99).collect()] == exact
    before = index.log.state()
    assert index.build(files.limit(3), commit="b") and index.log.state().segments != before.segments and index.meta().first().file_count == 3
