"""Lines that contain any of many terms, in one pass for a slice of terms.

The terms go into an Aho-Corasick automaton, which finds all of them while it reads a line
once. Terms reach the tasks in slices of at most ``SLICE_CHARS`` characters (so the broadcast
and a task's automaton are of a known size); more terms are more passes over the lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.storage import remove, stored

#: Characters of the terms of one pass; an automaton takes some hundred bytes for each.
SLICE_CHARS = 1 << 18


def find(lines: DataFrame, terms: DataFrame, slice_chars: int = SLICE_CHARS, carry: Sequence[str] = ("path", "line", "snippet")) -> DataFrame:
    """term and the columns ``carry`` of each row of ``lines`` whose ``snippet`` contains a term of ``terms`` (term).

    Each term counts once a line; empty and null terms are in none. Matching is by exact characters.
    """
    spark, held = lines.sparkSession, []
    own = stored(terms.select("term").where("term <> ''").distinct().withColumn("n", F.length("term")), "terms", held)
    total = own.agg(F.sum("n")).first()[0] or 0
    n_slices = -(-total * 5 // (slice_chars * 4)) or 1  # a fifth more, as hashed slices differ in size
    sliced = own.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(n_slices)))
    schema = T.StructType([T.StructField("term", T.StringType()), *[lines.schema[c] for c in carry]])
    found = None
    for k in range(n_slices):
        part = [r[0] for r in sliced.where(F.col("slice") == k).select("term").toLocalIterator()]
        if not part:
            continue
        one = lines.select("snippet", *[F.col(c).alias(f"__{c}") for c in carry]).mapInArrow(_scanner(spark.sparkContext.broadcast(part), list(carry)), schema)
        found = one if found is None else found.unionByName(one)
    out = spark.createDataFrame([], schema) if found is None else stored(found, "term-lines")
    remove(spark, held)
    return out


def _scanner(terms_b, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for t in terms_b.value:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            which, hits = [], []
            for i, text in enumerate(batch.column("snippet").to_pylist()):
                if text:
                    for term in {t for _, t in automaton.iter(text)}:
                        which.append(i)
                        hits.append(term)
                if len(hits) >= 20_000:
                    yield rows(batch, which, hits)
                    which, hits = [], []
            if hits:
                yield rows(batch, which, hits)

    def rows(batch: pa.RecordBatch, which: list[int], hits: list[str]) -> pa.RecordBatch:
        at = pa.array(which)
        return pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), *[batch.column(f"__{c}").take(at) for c in carry]], ["term", *carry])

    return run
