"""Operator 1: best-fit packing by large-item matching.

Items longer than a third of a sequence fit at most two to a sequence. They are
matched greedily first, the longest with the longest that still fits beside it; the
shorter ones then go, longest first, into the least gap that takes them.

Lengths are whole numbers up to the capacity, so the packing is decided on the
*histogram* of lengths, which has ``capacity`` rows whatever the corpus: a placement
says that the items of one length with ranks r0.. go to sequences b0.., t to each,
from a given offset. Items find their placement by length and rank. Nothing but the
histogram is gathered, and no sequence is built in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm import textcore as tc
from tallyglass.llm import tokens
from tallyglass.llm.common import doc_columns, partitions_for, stored, whole_rows

CAPACITY, END_ID = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Parts that the items of one length are ranked in, at least, and bytes of items for another; a length that most items share spreads over so many tasks.
RANK_PARTS, RANK_BYTES = 256, 1 << 20


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of n tokens in pieces: all of the capacity, but the first, which may be shorter."""
    first = n % capacity or capacity
    return [n] if n <= capacity else [first] + [capacity] * ((n - first) // capacity)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, memo: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, little-endian 32-bit) for each piece of each row of ``docs``.

    A null text is an empty one: its only token is the end id.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer or tokens.public_path(TOKENIZER), share=memo)
        end = np.array([end_id], "<u4").tobytes()
        for batch in tc.slices(tc.trimmed(batches)):
            ids, counts = encoder.encode_all(tc.as_bytes(batch.column("text")))
            data, at = ids.tobytes(), 0
            owner, columns, held = [], ([], [], [], []), []
            for d, n_ids in enumerate(counts.tolist()):
                own = data[at : at + 4 * n_ids] + end
                at += 4 * n_ids
                start = 0
                for k, n in enumerate(piece_lengths(n_ids + 1, capacity)):
                    part = own[4 * start : 4 * (start + n)]
                    owner.append(d)
                    for c, v in zip(columns, (k, start, n, zlib.crc32(part)), strict=True):
                        c.append(v)
                    if with_ids:
                        held.append(part)
                    start += n
            out = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(held, pa.binary())] if with_ids else []), schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, r0, b0, t, offset), in order of length and r0, and the number of sequences.

    Items of a length with rank r from r0 on, up to the next placement, go to sequence
    b0 + (r - r0) // t at offset + (r - r0) % t * length.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    placements, used = [], dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: runs of sequences (first, count)
    widths: list[int] = []
    bins = 0

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(widths, gap)
            gaps[gap].append((first, count))

    def put(n: int, first: int, t: int, offset: int, count: int) -> None:
        placements.append((n, used[n], first, t, offset))
        used[n] += count
        left[n] -= count

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect_left(large, capacity - n + 1) - 1  # the longest beside it
        if fit < 0:
            count = left[n]
            put(n, bins, 1, 0, count)
            leave(capacity - n, bins, count)
        elif large[fit] == n:
            pairs, odd = divmod(left[n], 2)
            put(n, bins, 2, 0, left[n])
            leave(capacity - 2 * n, bins, pairs)
            leave(capacity - n, bins + pairs, odd)
            count = pairs + odd
            if odd and fit:  # the odd one may still have a shorter partner
                bins += pairs
                m = large[fit - 1]
                gaps[capacity - n].pop()
                if not gaps[capacity - n]:
                    del gaps[capacity - n]
                    widths.remove(capacity - n)
                put(m, bins, 1, n, 1)
                leave(capacity - n - m, bins, 1)
                count = 1
                if not left[m]:
                    large.remove(m)
        else:
            m = large[fit]
            count = min(left[n], left[m])
            put(n, bins, 1, 0, count)
            put(m, bins, 1, n, count)
            leave(capacity - n - m, bins, count)
            if not left[m]:
                large.remove(m)
        bins += count
        if not left[n]:
            large.remove(n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(widths, n)
            if at == len(widths):
                gap, first, count = capacity, bins, -(-left[n] // (capacity // n))
                bins += count
            else:
                gap = widths[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    widths.pop(at)
            t = gap // n
            took = min(left[n], t * count)
            full, rest = divmod(took, t)
            put(n, first, t, capacity - gap, took)
            leave(gap - t * n, first, full)
            if rest:
                leave(gap - rest * n, first + full, 1)
            leave(gap, first + full + bool(rest), count - full - bool(rest))
    return sorted(placements), bins


def pack(pieces: DataFrame, length_col: str = "length", order: list[str] | None = None, capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. Lengths from 1 to the capacity; an empty table stays empty.

    ``pieces`` is read twice and so should be stored. ``order`` (all other columns by default) ranks items of a
    length; items that agree in it are interchangeable. Columns of ``pieces`` may have any names.
    """
    spark = pieces.sparkSession
    parts = parts or partitions_for(pieces, RANK_BYTES, least=RANK_PARTS)
    order = order or [c for c in pieces.columns if c != length_col]
    ordered = [F.col(f"row.`{c}`") for c in order]
    salted = pieces.select(whole_rows(pieces).alias("row"), F.col(f"`{length_col}`").cast("long").alias("n"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64(*ordered), F.lit(parts)).cast("int"))
    counts = stored(salted.groupBy("n", "salt").agg(F.count("*").alias("count")), "length-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("n").agg(F.sum("count")).collect()}  # at most `capacity` rows
    placements, _ = plan(histogram, capacity)
    table = np.array(placements, np.int64).reshape(-1, 5)
    found = spark.sparkContext.broadcast((table[:, 0] << 48 | table[:, 1], table))
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("n").orderBy("salt")) - F.col("count")).drop("count")

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        keys, rows = found.value
        size, rank = lengths.to_numpy(), ranks.to_numpy()
        row = rows[np.searchsorted(keys, size << 48 | rank, "right") - 1]
        turn, slot = np.divmod(rank - row[:, 1], row[:, 3])
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + turn), pa.array(row[:, 4] + slot * size)], names=["sequence_id", "offset"])

    own = F.row_number().over(Window.partitionBy("n", "salt").orderBy(*ordered)).cast("long")
    ranked = salted.withColumn("rank", own).join(before, ["n", "salt"])
    placed = ranked.withColumn("place", place(F.col("n"), F.col("before") + F.col("rank") - 1))
    return placed.select("row.*", "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, memo: float = 1.0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row of ``docs``.

    Repeated rows are packed one by one; other columns are ignored. ``memo`` scales the tokenizer's memo in each worker.
    """
    pieces = stored(token_pieces(doc_columns(docs), tokenizer, end_id, capacity, with_ids, memo), "pieces")
    return pack(pieces, order=["doc_id", "piece", "start", "ids_crc32"], capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ``ids`` (little-endian 32-bit) of the packed sequences; ``packed`` with ids. A group is one sequence."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    parts = packed.groupBy("sequence_id").agg(F.transform(ordered, lambda x: x["ids"]).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, X'', (s, x) -> concat(s, x))").alias("ids"))


def op1(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{d}/documents.parquet"))


QUERIES = {"op1_best_fit_packing": op1}
