"""Operator 8: proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked there; the rank
divided by the source's size is a row's *fractional rank*. Sorting all rows by it
interleaves the sources in proportion, and cutting the sorted order into equal runs
gives shards whose counts differ by one at most and whose mixtures match the whole.

Neither ranking uses a window over a whole source or over all rows: rows are dealt
into hash ranges, the ranges are counted, and a row's rank is the number of rows in
earlier ranges plus its rank in its own. A source that holds most rows therefore
spreads over many tasks. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import stored

#: Ranges that the hash is cut into within a source, and the fractional rank over all rows.
HASH_RANGES = 1024
ORDER_RANGES = 8192


def _running(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of ``counts`` (n by range) with the number of rows in earlier ranges."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)
    return counts.withColumn("__before", F.sum("__n").over(w) - F.col("__n"))


def fractional_ranks(rows: DataFrame, strata: Column, shuffle: Column, ties: list[str], hash_ranges: int = HASH_RANGES) -> DataFrame:
    """``rows`` with ``__frac``: (rank - 1/2) / size of the stratum, ranks by ``shuffle`` (an unsigned 63-bit hash) then ``ties``.

    A null stratum is a stratum of its own.
    """
    df = rows.withColumn("__null", strata.isNull()).withColumn("__stratum", F.coalesce(strata.cast("string"), F.lit("")))
    df = df.withColumn("__h", shuffle).withColumn("__range", (F.col("__h") % hash_ranges).cast("int"))
    key = ["__null", "__stratum"]
    counts = _running(df.groupBy(*key, "__range").agg(F.count("*").alias("__n")), key, "__range")
    counts = counts.withColumn("__size", F.sum("__n").over(Window.partitionBy(*key))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*key, "__range").orderBy("__h", *ties))
    ranked = df.withColumn("__rank", own).join(counts, [*key, "__range"])
    return ranked.withColumn("__frac", (F.col("__before") + F.col("__rank") - F.lit(0.5)) / F.col("__size")).drop("__null", "__range", "__rank", "__before", "__size")


def shards(docs: DataFrame, n_shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_ranges: int = ORDER_RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of ``docs``.

    * size: bytes of the text plus 16; a null text counts no bytes and has the crc32 of nothing (0).
    * counts of two shards differ by one at most; slots run from 0 without gaps; fewer rows than
      shards leave the last ones empty; an empty table gives no rows.
    * repeated rows are placed one by one; ties of the hash fall by id, then size, then crc.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32")
    )
    shuffle = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    ties = ["doc_id", "size", "text_crc32"]
    ranked = fractional_ranks(rows, F.col("__source"), shuffle, ties).select(*ties, "__frac", "__stratum", "__h")
    ranked = stored(ranked.withColumn("__range", F.least(F.floor(F.col("__frac") * order_ranges), F.lit(order_ranges - 1)).cast("int")), "shard-ranks")
    counts = _running(ranked.groupBy("__range").agg(F.count("*").alias("__n")), [], "__range")
    total = counts.agg(F.sum("__n").alias("__total"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__frac", "__stratum", "__h", *ties))
    placed = (
        ranked.withColumn("__rank", own)
        .join(counts.drop("__n"), "__range")
        .join(F.broadcast(total), F.lit(True))  # one row
        .withColumn("__at", F.col("__before") + F.col("__rank") - 1)
    )
    # shard s begins at the least position p with p * n_shards >= s * total; integer arithmetic only
    placed = placed.withColumn("shard", F.expr(f"(__at * {n_shards}) div __total"))
    first = F.expr(f"(shard * __total + {n_shards} - 1) div {n_shards}")
    return placed.withColumn("slot", F.col("__at") - first).select(*ties, F.col("shard").cast("int"), F.col("slot").cast("long"))


def op8(spark: SparkSession, d: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{d}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_proportional_interleave": op8}
