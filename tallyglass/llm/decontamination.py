"""Operator 9: benchmark decontamination.

The windows of 13 consecutive normalised words of every benchmark item (an item of
fewer words is one window) are hashed; the set of hashes is broadcast and documents
are scanned once with vectorised window hashes. A window whose hash is in the set is
verified word by word before it counts.

The broadcast is bounded: the benchmark is cut into slices of at most
``MAX_SLICE_BYTES`` of item text. One slice (the usual case) means one scan. With more,
each slice is broadcast, scanned, and its broadcast removed before the next one's; the
hits are kept by text and come to the documents that have any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, key_filter, stored, whole_rows

WIDTH = 13
MAX_SLICE_BYTES = 16 << 20

#: A-Z to lower case; every other ASCII byte but digits and a-z separates words; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WindowIndex:
    """The windows of some benchmark items, by width and hash."""

    FILTER_BITS = 20

    def __init__(self, items: list[tuple[object, bytes | None]], width: int = WIDTH):
        self.ids: list[str] = []
        self.texts: list[bytes] = []
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for item_id, text in items:
            words = normal_words(text)
            if not words or item_id is None:
                continue
            k, w = len(self.ids), min(width, len(words))
            joined = b" ".join(words)
            self.ids.append(str(item_id))
            self.texts.append(joined)
            starts, ends = tc.bounds(joined)
            hashes = tc.window_hashes(tc.word_hashes(joined, starts, ends), w)
            parts.setdefault(w, []).append((hashes, np.full(len(hashes), k, np.int32), starts[: len(hashes)].astype(np.int32), ends[w - 1 :].astype(np.int32)))
        #: By width: hashes in order, and for each the item and the bytes of the window in it.
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        self.filters: dict[int, np.ndarray] = {}
        for w, held in parts.items():
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.windows[w] = tuple(c[order] for c in columns)
            bits = np.zeros(1 << self.FILTER_BITS, bool)
            bits[columns[0] >> tc.U64(64 - self.FILTER_BITS)] = True
            self.filters[w] = bits

    def scan(self, joined: bytes) -> tuple[int, np.ndarray, set[int]]:
        """Number of words, the words that are hit, and the items with an occurring window."""
        starts, ends = tc.bounds(joined)
        n = len(starts)
        hit, items = np.zeros(n, bool), set()
        if n == 0:
            return 0, hit, items
        words = tc.word_hashes(joined, starts, ends)
        shift = tc.U64(64 - self.FILTER_BITS)
        for w, (keys, item, first, last) in self.windows.items():
            if n < w:
                continue
            hashes = tc.window_hashes(words, w)
            at = np.flatnonzero(self.filters[w][hashes >> shift])
            low, high = np.searchsorted(keys, hashes[at], "left"), np.searchsorted(keys, hashes[at], "right")
            for i, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                passage = joined[starts[i] : ends[i + w - 1]]
                for j in range(a, b):
                    k = int(item[j])
                    if self.texts[k][first[j] : last[j]] == passage:
                        hit[i : i + w] = True
                        items.add(k)
        return n, hit, items


def _items_in_slices(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, bytes | None]]]:
    """The items, in lists of at most ``most`` bytes of text (a longer item is a list of its own)."""
    held, size = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator(prefetchPartitions=False):
        text = row[1].encode() if row[1] is not None else None
        if held and size + len(text or b"") > most:
            yield held
            held, size = [], 0
        held.append((row[0], text))
        size += len(text or b"")
    if held:
        yield held


_SCAN = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
)


def _scan_column(index_b):
    @F.arrow_udf(_SCAN)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_b.value
        for column in tc.trimmed(texts):
            n_words, n_hit, hits, items = [], [], [], []
            for text in tc.each_text(column):
                n, hit, found = index.scan(b" ".join(normal_words(text)))
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                hits.append(tc.mask_ranges(hit).tolist())
                items.append(sorted(index.ids[k] for k in found))
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=_SCAN.fieldNames()
            )

    return scan


def _scans(rows: DataFrame, benchmark: DataFrame, width: int, max_slice_bytes: int) -> DataFrame:
    """``rows`` (with ``text``) and ``scan``."""
    spark = rows.sparkSession
    slices = _items_in_slices(benchmark, "item_id", "text", max_slice_bytes)
    first, second = next(slices, []), next(slices, None)
    one = lambda items: spark.sparkContext.broadcast(WindowIndex(items, width))
    if second is None:
        return rows.withColumn("scan", _scan_column(one(first))("text"))
    keyed = rows.withColumn("key", F.xxhash64("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    found = None
    for items in chain((first, second), slices):
        index_b = one(items)
        scan = keyed.select("key", "digest", _scan_column(index_b)("text").alias("s")).where("s.n_hit > 0")
        hits = stored(scan.select("key", "digest", "s.hits", "s.items").dropDuplicates(["key", "digest"]), "benchmark-hits")
        index_b.unpersist()
        found = hits if found is None else found.unionByName(hits)
    lists = [F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")]
    found = found.groupBy("key", "digest").agg(*lists).withColumn("n_hit", _n_hit("hits"))  # a row for each slice at most
    found = stored(found.withColumnsRenamed({"key": "k", "digest": "g"}), "benchmark-found")
    plain = keyed.withColumn("scan", _scan_column(one([]))("text"))
    maybe = key_filter(found, "k")(F.col("key"))
    rest = plain.where(~maybe).select(*rows.columns, "scan")
    judged = plain.where(maybe).join(found, (F.col("key") == F.col("k")) & (F.col("digest") == F.col("g")), "left")
    none = F.col("k").isNull()
    pick = lambda c: F.when(none, F.col("scan")[c]).otherwise(F.col(c)).alias(c)
    scan = F.struct(F.col("scan")["n_words"].alias("n_words"), pick("n_hit"), pick("hits"), pick("items")).alias("scan")
    return rest.unionByName(judged.select(*rows.columns, scan))


def scan_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_slice_bytes: int = MAX_SLICE_BYTES) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever they are called) and ``scan``: n_words, n_hit, hits (word ranges start, end, ...) and items (ids as sorted strings).

    * null or empty text: no words, no hits; an empty benchmark hits nothing.
    * items without words, or without an id, have no window; items that repeat are one id in ``items``.
    * each row is judged on its own, so repeated rows get equal results.
    """
    rows = docs.select(whole_rows(docs).alias("row"), F.col("text").alias("text"))
    return _scans(rows, benchmark, width, max_slice_bytes).select("row", "scan")


@F.arrow_udf(T.LongType())
def _n_hit(column: pa.Array) -> pa.Array:
    out = []
    for r in column.to_pylist():
        reach = total = 0
        for a, b in sorted(zip(r[::2], r[1::2], strict=True)):
            total += max(0, b - max(a, reach))
            reach = max(reach, b)
        out.append(total)
    return pa.array(out, pa.int64())


def verdicts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, max_slice_bytes: int = MAX_SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row, with the ``items`` and ``hits`` themselves."""
    out = _scans(doc_columns(docs), benchmark, width, max_slice_bytes).select("doc_id", "scan.*")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "hits",
    )


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for text, r in zip(tc.as_bytes(texts), hits.to_pylist(), strict=True):
        out.append(text.decode() if text is not None and not r else None if text is None else remove_spans(text, r))
    return pa.array(out, pa.string())


def remove_spans(text: bytes, ranges: list[int]) -> str:
    """The text without the bytes from the first to the last word of each range; what separates words elsewhere stays."""
    buf = np.frombuffer(text.translate(_TABLE), np.uint8)
    space = buf == 32
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    starts, ends = edge[::2], edge[1::2]
    gone = np.zeros(len(text), bool)
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        gone[starts[a] : ends[b - 1]] = True
    return np.frombuffer(text, np.uint8)[~gone].tobytes().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WIDTH) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``), or with their hit spans cut out (``"spans"``).

    A document is contaminated if words are hit and they are a twentieth of its words or more.
    Other rows and all columns come back unchanged.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    scanned = scan_documents(docs, benchmark, width)
    hit = F.col("scan")["n_hit"]
    bad = (hit > 0) & (20 * hit >= F.col("scan")["n_words"])
    if mode == "documents":
        return scanned.where(~bad).select("row.*")
    text = F.col("row.text")
    cut = F.when(bad, _without(text, F.col("scan")["hits"])).otherwise(text).alias("text")
    return scanned.select(*[cut if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op9(spark: SparkSession, d: str) -> DataFrame:
    out = verdicts(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"))
    return out.drop("items", "hits")


def brute(text: str | None, items: list[tuple[object, str | None]]) -> tuple[int, int, int, str, bool]:
    """The contract for one document, straight from its definition."""
    words = normal_words(text.encode()) if text else []
    hit, found = set(), set()
    for item_id, item in items:
        w = normal_words(item.encode()) if item else []
        if not w:
            continue
        k = min(WIDTH, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


QUERIES = {"op9_benchmark_decontamination": op9}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op9_benchmark_decontamination": f"""
WITH items AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
item_starts AS (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM items),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS t FROM item_starts),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
doc_starts AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items)),
found AS (SELECT d.doc_id, d.i, d.k, w.item_id FROM (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS t FROM doc_starts) d JOIN item_windows w USING (k, t)),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)"""
}
