"""Connected components by alternating large and small stars, in DataFrame operations.

Every round is two group-bys and two joins; the edges are written to the shared
folder after each, so a round that loses an executor starts from stored files. A
hub's edges are reduced by a partial minimum and spread again by AQE's skew join;
nothing is gathered in one task or on the driver but two totals a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

MAX_ROUNDS = 64


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of ``edges`` (u, v long).

    Self-loops and repeated edges are allowed; an empty table gives an empty table.
    """
    e = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total = F.expr("count(*)"), F.expr("sum(CAST(xxhash64(u, v) AS DECIMAL(38, 0)))")
    before = e.agg(*total).first()
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        e = stored(_small(_large(e).where("u != v").distinct()), "edges")
        now = e.agg(*total).first()
        if tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
