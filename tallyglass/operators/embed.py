"""Embedding behind a provider protocol, with oversized texts split and averaged, and adaptive retry."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.text import split_at_lines

#: Words counted by the built-in deterministic embedder, by topic.
TOPICS = (("the", "and"), ("ion", "tion"), ("que", "les"), ("der", "ung"), ("por", "ado"))
LEAST_CAP, ATTEMPTS = 512, 5


class Overflow(Exception):
    """A text was too long for the model."""


class Provider(Protocol):
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


def keyword_vector(content: Column) -> Column:
    """Counts of topic words and a constant, of norm 1; JVM-side."""
    low = F.lower(content)
    counts = []
    for words in TOPICS:
        n = F.lit(0)
        for w in words:
            n = n + F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w))
        counts.append(n.cast("double"))
    raw = F.array(*counts, F.lit(0.01))
    # each step binds the one before to a variable, so that counts and norm are computed once for a text
    normed = F.transform(F.array(raw), lambda r: F.struct(r.alias("r"), F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.transform(normed, lambda s: F.transform(s["r"], lambda x: x / s["n"]))[0]


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """The mean of each group's vectors, place by place; partial sums before the shuffle."""
    places = vectors.select(key, F.posexplode("vector").alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return places.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("vector"))


def micro_batches(texts: list[str], cap: int) -> Iterator[list[str]]:
    """Runs of texts of at most ``cap`` characters together, one text at least."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > cap:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class BatchEmbedder:
    """Splits long texts, embeds parts in micro-batches, averages them back; halves its cap when the model overflows.

    The lower cap holds for later calls too.
    """

    def __init__(self, provider: Provider, cap: int):
        self.provider, self.cap = provider, cap

    def embed(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(ATTEMPTS):
            try:
                return self._once(texts)
            except Overflow:
                if self.cap <= LEAST_CAP or attempt == ATTEMPTS - 1:
                    raise
                self.cap = max(LEAST_CAP, self.cap // 2)
        raise AssertionError

    def _once(self, texts: list[str]) -> list[list[float]]:
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = split_at_lines(t, self.cap)
            parts += own
            owner += [i] * len(own)
        vectors = [x for batch in micro_batches(parts, self.cap) for x in self.provider.embed_batch(batch)]
        sums: list[list[float]] = [[] for _ in texts]
        counts = [0] * len(texts)
        for i, x in zip(owner, vectors, strict=True):
            sums[i] = [a + b for a, b in zip(sums[i], x, strict=True)] if sums[i] else list(x)
            counts[i] += 1
        return [[a / n for a in s] for s, n in zip(sums, counts, strict=True)]


def embed(chunks: DataFrame, provider: Callable[[], Provider], cap: int = 8192, batch: int = 64) -> DataFrame:
    """``chunks`` with ``vector``; a provider is made in each task, and texts go to it in batches of ``batch``."""
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = BatchEmbedder(provider(), cap)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                own = b.slice(i, batch)
                vectors = embedder.embed([t or "" for t in own.column("content").to_pylist()])
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(vectors, pa.list_(pa.float32()))], schema.fieldNames())

    return chunks.mapInArrow(run, schema)
