"""Operator 2: substring dedup over a log-structured fingerprint index.

Every run of 35 consecutive words (a window) has an 80-bit fingerprint: a 64-bit
primary, by which runs are sorted, and 16 bits of an independent second hash, by
which equal primaries are verified. The index is a log of immutable runs, each cut
into buckets by the primary's leading bits and sorted within them.

* A *batch* of documents becomes sorted runs first: a task gathers documents into a
  block, fingerprints it, drops what repeats inside the block (so a hot window, a
  document of one word or a group of copies costs one entry a block), and deals the
  distinct entries to the buckets as packed sorted arrays with their positions.
* A bucket *merge-joins* its runs, those of the batch and those of history, on the
  primary and verifies on the second hash. The answer for each block is the
  positions that also occur elsewhere.
* The batch's own distinct fingerprints can be appended to the log as a new run, and
  :meth:`FingerprintIndex.compact` merges runs into one.

Answers travel back as positions by block, become word ranges by document, and one
join brings them to the texts. Each step's rows are packed arrays, so 130 million
windows cross the network as a few ten thousand rows of 11 bytes a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm.common import doc_columns, drop_path, key_filter, lean, partitions_for, scratch, stored

WIDTH = 35
#: Words in a block of documents (positions in a block take three bytes), and text bytes a bucket is meant to serve.
BLOCK_WORDS = 1 << 20
BUCKET_BYTES = 4 << 20
#: A stop in a block's position space between documents.
_GAP = 1

_RUN_SCHEMA = "bucket int, block long, n long, high binary, low binary, at binary, docs binary"


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as six-byte gaps, or plainly where a gap is too wide."""
    gaps = np.diff(values, prepend=tc.U64(0))
    if len(gaps) and int(gaps.max()) < 1 << 48:
        return b"6" + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"8" + values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"8":
        return np.frombuffer(data, np.uint64, offset=1)
    packed = np.frombuffer(data, np.uint8, offset=1).reshape(-1, 6)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :6] = packed
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _pack3(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack3(data: bytes) -> np.ndarray:
    packed = np.frombuffer(data, np.uint8).reshape(-1, 3)
    wide = np.zeros((len(packed), 4), np.uint8)
    wide[:, :3] = packed
    return wide.view("<u4").ravel().astype(np.int64)


def fingerprints(joined: bytes, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and primary and second hash of each window."""
    starts, ends = tc.bounds(joined)
    if len(starts) < width:
        return len(starts), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
    high = tc.window_hashes(tc.word_hashes(joined, starts, ends), width)
    low = tc.second_hashes(tc.word_hashes(joined, starts, ends, 1), width)
    return len(starts), high, (low >> tc.U64(48)).astype(np.uint16)


class _Block:
    """Documents gathered for one set of sorted runs."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.keys: list[bytes] = []
        self.first: list[int] = []
        self.high: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.at: list[np.ndarray] = []

    def add(self, key: bytes, high: np.ndarray, low: np.ndarray) -> None:
        self.keys.append(key)
        self.first.append(self.size)
        self.high.append(high)
        self.low.append(low)
        self.at.append(np.arange(self.size, self.size + len(high), dtype=np.int64))
        self.size += len(high) + _GAP

    def rows(self, buckets: int) -> Iterator[tuple]:
        """A row with the directory and what repeats within the block, then a row for each bucket."""
        high, low, at = (np.concatenate(x) if x else np.zeros(0) for x in (self.high, self.low, self.at))
        self.high = self.low = self.at = []
        order = np.argsort(high, kind="stable")
        # equal primaries with different second hashes must stay apart: order such stretches by both
        high, low, at = high[order], low[order], at[order]
        same = high[1:] == high[:-1]
        if (same & (low[1:] != low[:-1])).any():
            order = np.lexsort((low, high))
            high, low, at = high[order], low[order], at[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(new) - 1
        repeated = np.bincount(group, minlength=1)[group] > 1 if len(high) else new
        directory = np.array(self.first, "<i8").tobytes() + b"".join(self.keys)
        here = np.sort(at[repeated])
        yield -1, self.number, len(self.keys), b"", b"", _pack3(here), directory
        high, low, at = high[new], low[new], at[new]
        cuts = np.searchsorted((high >> tc.U64(32)) * tc.U64(buckets) >> tc.U64(32), np.arange(buckets + 1))
        for b in range(buckets):
            i, j = int(cuts[b]), int(cuts[b + 1])
            if i < j:
                yield b, self.number, j - i, _pack(high[i:j]), low[i:j].tobytes(), _pack3(at[i:j]), b""


def _run_rows(width: int, buckets: int, block_words: int):
    names = [f.split()[0] for f in _RUN_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def out(block: _Block) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in block.rows(buckets):
            held.append(row)
            size += sum(len(x) for x in row[3:])
            if size > 4 << 20:
                yield emit(held)
                held, size = [], 0
        if held:
            yield emit(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in tc.slices(tc.trimmed(batches)):
            for key, text in zip(batch.column("key").to_pylist(), tc.as_bytes(batch.column("text")), strict=True):
                _, high, low = fingerprints(b" ".join(text.split()), width) if text else (0, (), ())
                # a document longer than a block is cut into parts that hold all of its windows between them
                for i in range(0, len(high), block_words):
                    part = high[i : i + block_words]
                    if block.size and block.size + len(part) > block_words:
                        yield from out(block)
                        block = _Block(block.number + 1)
                    block.add(key + i.to_bytes(8, "little"), part, low[i : i + block_words])
        if block.keys:
            yield from out(block)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One bucket: which entries of each block occur in another run (directory rows pass through)."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        return table.select(["block", "at", "docs"])
    rows = table.select(["block", "high", "low", "at"]).to_pylist()
    size = [len(r["low"]) // 2 for r in rows]
    high = np.concatenate([_unpack(r["high"]) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint16) for r in rows])
    order = np.argsort(high, kind="stable")
    sorted_high, sorted_low = high[order], low[order]
    same = sorted_high[1:] == sorted_high[:-1]
    if (same & (sorted_low[1:] != sorted_low[:-1])).any():
        order = np.lexsort((low, high))
        sorted_high, sorted_low = high[order], low[order]
        same = sorted_high[1:] == sorted_high[:-1]
    same &= sorted_low[1:] == sorted_low[:-1]
    seen = np.zeros(len(high), bool)
    seen[order[1:][same]] = True
    seen[order[:-1][same]] = True
    blocks, at, end = [], [], 0
    for r, n in zip(rows, size, strict=True):
        found = seen[end : end + n]
        end += n
        if r["block"] >= 0 and found.any():  # history (block -1) gets no answer
            blocks.append(r["block"])
            at.append(_pack3(np.sort(_unpack3(r["at"])[found])))
    return pa.table({"block": pa.array(blocks, pa.int64()), "at": pa.array(at, pa.binary()), "docs": pa.array([b""] * len(blocks), pa.binary())})


def _ranges_of_block(width: int, key_bytes: int):
    def ranges(table: pa.Table) -> pa.Table:
        directory = next(d for d in table.column("docs").to_pylist() if d)
        at = np.concatenate([_unpack3(x) for x in table.column("at").to_pylist()])
        at.sort()
        step = 8 + key_bytes + 8
        n = len(directory) // step
        first = np.frombuffer(directory, "<i8", n)
        keys, removed = [], []
        cuts = np.append(np.searchsorted(at, first), len(at))
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            entry = directory[8 * n + (key_bytes + 8) * d :][: key_bytes + 8]
            begins = at[cuts[d] : cuts[d + 1]] - first[d] + int.from_bytes(entry[key_bytes:], "little")
            keys.append(entry[:key_bytes])
            gap = np.flatnonzero(begins[1:] > begins[:-1] + width)  # windows that leave a word between them
            flat = np.empty(2 * (len(gap) + 1), np.int64)
            flat[::2] = np.concatenate((begins[:1], begins[gap + 1]))
            flat[1::2] = np.concatenate((begins[gap], begins[-1:])) + width
            removed.append(flat)
        values = pa.array(np.concatenate(removed) if removed else np.zeros(0, np.int64), pa.int64())
        offsets = pa.array(np.cumsum([0, *map(len, removed)]), pa.int32())
        return pa.table({"key": pa.array(keys, pa.binary()), "ranges": pa.ListArray.from_arrays(offsets, values)})

    return ranges


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``key``: 16 bytes of a digest of both, equal only for rows with equal results."""
    parts = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary"), F.lit(" ").cast("binary"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumn("key", F.unhex(F.md5(parts)))


class FingerprintIndex:
    """A log of runs in a folder that all executors share.

    ``width`` and ``buckets`` are fixed for the life of an index; ``path`` None keeps no history.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, width: int = WIDTH, buckets: int | None = None):
        self.spark, self.path, self.width, self.buckets = spark, path, width, buckets

    def runs(self) -> list[str]:
        if self.path is None:
            return []
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [x.getPath().toString() for x in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(done)

    def _history(self) -> DataFrame | None:
        runs = self.runs()
        return self.spark.read.schema(_RUN_SCHEMA).parquet(*runs) if runs else None

    def _batch_runs(self, docs: DataFrame, buckets: int, block_words: int) -> DataFrame:
        return docs.mapInArrow(_run_rows(self.width, buckets, block_words), _RUN_SCHEMA)

    def repeated(self, docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
        """``key`` and ``ranges`` (word ranges start, end, ... that repeat in the batch or in history) of keyed documents."""
        buckets = self.buckets or min(32_000, partitions_for(docs, BUCKET_BYTES, least=8))
        runs = self._batch_runs(docs, buckets, block_words)
        if (history := self._history()) is not None:
            runs = runs.unionByName(history)
        # directory rows are spread by block, the others meet by bucket
        spread = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.lit(-1).cast("long"))
        answers = runs.withColumn("spread", spread).groupBy("bucket", "spread").applyInArrow(_merge, "block long, at binary, docs binary")
        found = answers.groupBy("block").applyInArrow(_ranges_of_block(self.width, 16), "key binary, ranges array<bigint>")
        # equal rows, and the parts of a very long document, are merged here
        return found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_set(F.expr("transform(sequence(0, size(ranges) - 1, 2), i -> struct(ranges[i] AS a, ranges[i + 1] AS b))")))).alias("ranges"))

    def append(self, docs: DataFrame, block_words: int = BLOCK_WORDS) -> str:
        """Write the batch's distinct fingerprints as a new immutable run."""
        if self.path is None or self.buckets is None:
            raise ValueError("an index with history needs a path and a number of buckets")
        name = f"{self.path.rstrip('/')}/run-{len(self.runs()):06d}-{scratch(self.spark, 'r')[-8:]}"
        runs = self._batch_runs(_keyed(doc_columns(docs)), self.buckets, block_words).where("bucket >= 0")
        self._compacted(runs).write.parquet(name)
        return name

    def _compacted(self, runs: DataFrame) -> DataFrame:
        return runs.groupBy("bucket").applyInArrow(_compact, _RUN_SCHEMA)

    def compact(self) -> str | None:
        """Merge all runs into one; the old ones go only when the new one is complete."""
        old = self.runs()
        if len(old) < 2:
            return old[0] if old else None
        name = f"{self.path.rstrip('/')}/run-{len(old):06d}-{scratch(self.spark, 'r')[-8:]}"
        self._compacted(self.spark.read.schema(_RUN_SCHEMA).parquet(*old)).write.parquet(name)
        for p in old:
            drop_path(self.spark, p)
        return name


def _compact(table: pa.Table) -> pa.Table:
    """The distinct entries of a bucket's runs as one sorted run (block -1: history)."""
    rows = table.select(["bucket", "high", "low"]).to_pylist()
    high = np.concatenate([_unpack(r["high"]) for r in rows])
    low = np.concatenate([np.frombuffer(r["low"], np.uint16) for r in rows])
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    high, low = high[new], low[new]
    columns = {"bucket": pa.int32(), "block": pa.int64(), "n": pa.int64(), "high": pa.binary(), "low": pa.binary(), "at": pa.binary(), "docs": pa.binary()}
    row = (rows[0]["bucket"], -1, len(high), _pack(high), low.tobytes(), b"", b"")
    return pa.table({k: pa.array([v], t) for (k, t), v in zip(columns.items(), row, strict=True)})


def _judged(docs: DataFrame, index: FingerprintIndex, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Keyed documents that lose nothing for sure, and the others with ``ranges`` (array<struct<a,b>> or null).

    Only texts that may lose something are shuffled to their ranges; the others pass by.
    """
    keyed = _keyed(docs)
    ranges = stored(index.repeated(keyed, block_words), "repeated-ranges")
    marked = keyed.withColumn("maybe", key_filter(ranges.select(F.xxhash64("key").alias("key")))(F.xxhash64("key")))
    return marked.where("NOT maybe").drop("maybe"), marked.where("maybe").drop("maybe").join(ranges.hint("shuffle_hash"), "key", "left")


_DIGEST = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _kept(text: bytes | None, ranges: list[dict] | None) -> tuple[int, list[bytes]]:
    words = text.split() if text else []
    if not ranges:
        return len(words), words
    kept, reach = [], 0
    for r in ranges:
        kept += words[reach : r["a"]] if r["a"] > reach else []
        reach = max(reach, r["b"])
    return len(words), kept + words[reach:]


@F.arrow_udf(_DIGEST)
def _digest(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    n_words, n_removed, digest = [], [], []
    for text, r in zip(tc.as_bytes(texts), ranges.to_pylist(), strict=True):
        n, kept = _kept(text, r)
        n_words.append(n)
        n_removed.append(n - len(kept))
        digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())], names=["n_words", "n_removed", "kept_sha256"])


@F.arrow_udf(T.StringType())
def _kept_text(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    return pa.array([(b" ".join(_kept(t, r)[1]) if r else t) for t, r in zip(tc.as_bytes(texts), ranges.to_pylist(), strict=True)], pa.binary()).cast(pa.string())


def removal_digests(docs: DataFrame, index: FingerprintIndex | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word ranges, one row for each row of ``docs``.

    * A null text has no words; a text of fewer words than a window loses none.
    * Windows are judged on the input: all places where a sequence occurs lose it, in the same document too.
    * Repeated rows are documents like any others, so copies of 35 words or more lose all their words.
    * An empty table gives no rows; other columns are ignored.
    """
    docs = doc_columns(docs)
    whole, joined = _judged(docs, index or FingerprintIndex(docs.sparkSession), block_words)
    joined = whole.withColumn("ranges", F.lit(None).cast(joined.schema["ranges"].dataType)).unionByName(joined)
    return joined.select("doc_id", "ranges", _digest("text", "ranges").alias("__d")).select("doc_id", "__d.*", "ranges")


def dedup(docs: DataFrame, index: FingerprintIndex | None = None, text_col: str = "text", block_words: int = BLOCK_WORDS, size_col: str | None = None) -> DataFrame:
    """``docs`` with repeated passages cut from ``text_col``; a text that loses nothing stays as it is, byte for byte.

    ``size_col`` names a column that has the number of characters of the text; it follows where the text changes.
    """
    lean(docs.sparkSession)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*others).alias("row"), F.col("doc_id"), F.col(text_col).alias("text"))  # the text itself travels once
    same, joined = _judged(whole, index or FingerprintIndex(docs.sparkSession), block_words)
    cut = joined.withColumn("cut", F.size("ranges") > 0).withColumn("text", _kept_text("text", "ranges"))
    both = cut.select("row", "text", "cut").unionByName(same.select("row", "text", F.lit(False).alias("cut")))

    def column(c: str):
        if c == text_col:
            return F.col("text")
        own = F.col(f"row.`{c}`")
        return F.when(F.col("cut"), F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == size_col else own

    return both.select(*[column(c).alias(c) for c in docs.columns])


def op2(spark: SparkSession, d: str) -> DataFrame:
    return removal_digests(spark.read.parquet(f"{d}/documents.parquet")).drop("ranges")


def brute(texts: list[str | None], width: int = WIDTH) -> list[tuple[int, int, str]]:
    """The contract from its definition, for small tables."""
    words = [(t or "").encode().split() for t in texts]
    count: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - width + 1):
            count[tuple(w[i : i + width])] = count.get(tuple(w[i : i + width]), 0) + 1
    out = []
    for w in words:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


QUERIES = {"op2_substring_dedup": op2}

ORACLES = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM starts),
repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows SEMI JOIN repeated USING (k)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
}
