"""A real embedder that needs no model: hashed word n-grams, weighted by inverse document frequency.

Words and pairs of words are hashed to ``CODES`` codes; a code has a place of the vector and a sign. Its weight is the inverse
document frequency over all parts, so the table of weights has ``CODES`` entries however large the corpus is, and is broadcast.
Frequencies are counted task by task before they are shuffled; vectors need no shuffle but for texts of several parts.

Oversized texts are cut into parts of ``PART_WORDS`` words, which are embedded alone; a text's vector is the mean of its parts'.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.embed import mean_vectors
from tallyglass.storage import small_batches, stored

CODES, DIM = 1 << 18, 64
PART_WORDS = 256
#: The number of a pair of words is that of the first times this, plus that of the second.
PAIR = 1_000_003
#: Weights are whole millionths, so that sums don't depend on their order.
SCALE = 1_000_000
#: Words whose numbers a task keeps at hand.
KEPT_WORDS = 1 << 16
#: Rows that a task works on at a time, and bytes of text that it is given at a time.
ROWS, BATCH_BYTES = 1024, 4 << 20
_WORD = re.compile(rb"[a-z0-9_]+")


class _Numbers(dict):
    """Word -> the first 32 bits of its MD5."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        number = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big")
        return number


def text_codes(text: str | None, part_words: int, numbers: _Numbers) -> list[np.ndarray]:
    """The codes of each part's words and pairs of neighbours, repeats included; words are lower-cased runs of ASCII letters, digits
    and underscores. A text without words has one part without codes."""
    words = _WORD.findall(text.encode().lower()) if text else []
    out = []
    for i in range(0, max(len(words), 1), part_words):
        own = words[i : i + part_words]
        n = np.fromiter(map(numbers.__getitem__, own), np.int64, len(own))
        out.append((np.concatenate((n, n[:-1] * PAIR + n[1:])) % CODES).astype(np.int32))
    return out


def parts(texts: DataFrame, key: str, text: str, part_words: int = PART_WORDS) -> DataFrame:
    """key, parts (their number), part (from 0), codes."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = _Numbers()
        for column in batches:
            found = [text_codes(t.as_py(), part_words, numbers) for t in column]
            flat = [c for own in found for c in own]
            inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, flat)], dtype=np.int32), np.concatenate(flat) if flat else np.zeros(0, np.int32))
            yield pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), inner)

    found = texts.select(key, coded(text).alias("found"))
    return found.select(key, F.size("found").alias("parts"), F.posexplode("found").alias("part", "codes"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each entry of a column of lists."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CODES + 1, np.int64)
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        row, code = _flat(batch.column(0))
        place = np.sort(row * CODES + code)
        first = place[np.diff(place, prepend=-1) > 0]  # each code once a row
        counts[:CODES] += np.bincount(first % CODES, minlength=CODES)
        counts[CODES] += batch.num_rows
    code = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(counts[code])], ["code", "n"])


def frequencies(all_parts: DataFrame) -> DataFrame:
    """code, n: the parts that have a code, and under the code ``CODES`` the parts; so many rows at most, also from each task."""
    return all_parts.select("codes").mapInArrow(_counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def weights(counts: DataFrame) -> np.ndarray:
    """For each code the whole millionths of 1 + ln((1 + parts) / (1 + parts with the code)), negative where its sign is."""
    rows = counts.toPandas()  # CODES + 1 rows at most
    n = np.zeros(CODES + 1, np.int64)
    n[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    weight = np.round((1 + np.log((1.0 + n[CODES]) / (1.0 + n[:CODES]))) * SCALE)
    return np.where(np.arange(CODES) // DIM % 2 == 0, weight, -weight)


def embed_hashed(texts: DataFrame, key: str = "id", text: str = "content", part_words: int = PART_WORDS) -> DataFrame:
    """key, vector (``DIM`` doubles), one row for each text; a text without words (or null) has zeros. ``key`` is unique.

    Each part's vector has norm 1, so the mean of several has at most 1.
    """
    with small_batches(texts.sparkSession, BATCH_BYTES):
        cut = stored(parts(texts, key, text, part_words), "parts")  # read twice
    weight = texts.sparkSession.sparkContext.broadcast(weights(frequencies(cut)))

    def of_rows(codes: pa.Array) -> np.ndarray:
        row, code = _flat(codes)
        sums = np.bincount(row * DIM + code % DIM, weights=weight.value[code], minlength=len(codes) * DIM).reshape(-1, DIM)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.divide(sums, norms, out=np.zeros(sums.shape), where=norms > 0).ravel()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vector(codes: pa.Array) -> pa.Array:
        values = [of_rows(codes.slice(i, ROWS)) for i in range(0, len(codes), ROWS)]
        return pa.ListArray.from_arrays(np.arange(0, len(codes) * DIM + 1, DIM, dtype=np.int32), np.concatenate(values) if values else np.zeros(0))

    embedded = cut.select(key, "part", "parts", vector("codes").alias("vector"))
    alone = embedded.where("parts = 1").select(key, "vector")
    return alone.unionByName(mean_vectors(embedded.where("parts > 1"), key))
