"""Vector search queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators.vector_search import top_k
from tallyglass.plans.registry import query


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("language")
    )


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    """The embedding of one row: a query text's vector in this test data."""
    row = spark.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]]


_SCORED = """
  SELECT e.vec_id AS id, CAST(e.label AS INT) AS language,
         round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
"""


@query("vector_topk", f"SELECT id, language, score FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 5")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return top_k(_vectors(spark, d), query_vector(spark, d), 5).select("id", "language", "score")
