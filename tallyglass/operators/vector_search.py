"""Exact filtered top-k by cosine similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.vector_blocks import SPLIT_ROWS, best_pairs, packed

DEFAULT_K = 10


def cosine(vector: Column | str, query: Sequence[float]) -> Column:
    """Cosine of a vector column with a literal query vector, in double, rounded to 6 places.

    The query's norm is folded into a constant; both sums stay JVM-side.
    A zero vector on either side scores 0.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    q = F.array(*[F.lit(float(x)) for x in query])
    qn = sum(float(x) ** 2 for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.round(F.when((norm == 0) | F.lit(qn == 0), F.lit(0.0)).otherwise(dot / (norm * F.lit(qn or 1.0))), 6)


def top_k(vectors: DataFrame, query: Sequence[float], k: int = DEFAULT_K, language: str | int | None = None) -> DataFrame:
    """The k best rows by score, ties by id; a k of 0 or less means the default of ten.

    The language filter is an equality on the stored column, so it reaches the scan;
    ``orderBy().limit()`` becomes TakeOrderedAndProject, which keeps k rows a partition.
    """
    k = k if k > 0 else DEFAULT_K
    df = vectors if language is None else vectors.where(F.col("language") == F.lit(language))
    return df.withColumn("score", cosine("vector", query)).orderBy(F.desc("score"), "id").limit(k)


def similarity_join(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """query_id, id, score: for each row of ``queries`` the k best rows of ``vectors`` (both id, vector), ties by id.

    Both sides are cut into blocks, every block of queries meets every block of vectors in a matrix product, and k rows a
    query come out of it. Vectors are of one length; null ones are left out; a zero vector scores 0.
    """
    both = [df.select("id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL").withColumn("list", F.lit(0)) for df in (vectors, queries)]
    n_splits = max(1, -(-vectors.count() // split_rows))
    split = F.pmod(F.xxhash64("id"), F.lit(n_splits)).cast("int")
    right = packed(both[0].withColumn("split", split), ["list", "split"])
    left = packed(both[1].withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")), ["list", "deal"])
    left = left.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    return best_pairs(left, right, k)
