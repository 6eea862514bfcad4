import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.llm import fill_in_middle as fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ 1\néĀ世\U0001f600<S>"), max_size=40), st.integers(1, 9))
def test_cuts_are_those_of_the_units(text, stretch):
    units = UNIT.findall(text)
    t = fim.EncodedText(text.encode(), stretch)
    assert (t.n_units, t.n_chars) == (len(units), len(text))
    for c in range(len(units) + 1):
        assert t.cut(c) == len("".join(units[:c]))


def test_against_brute_force_and_round_trip(spark):
    texts = ["", None, "abc", "a b", "<P> inside", "x<S", "S>y", "é世😀 one two\r\n", "İİ", "<" * 30, "word " * 3000, "é" * 5000 + "Z" * 5000, "A" * 70_000]
    rows = [(None if i == 5 else i, texts[i % len(texts)], 1, "plain") for i in range(600)] + [(0, "abc def", 2, "x")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    out = fim.transform(df)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()], key=key)
    assert got == sorted([(i, *brute(i, t)) for i, t, *_ in rows], key=key)
    assert {"psm", "spm", "plain"} == {r[2] for r in got}
    back = [tuple(r) for r in out.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(back, key=key) == sorted([(i, t or "") for i, t, *_ in rows], key=key)
    assert fim.transform(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = fim.op12(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        *head, output = brute(r["doc_id"], texts[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], *head, sha(output), sha(texts[r["doc_id"]] or ""))
