"""Operator 11: mixing sources to target weights by systematic sampling.

Every document of a source is expected equally often: target / size of the source, at
most three times. Documents are put in order of size (in steps of a sixteenth at most)
and, among alike sizes, of a hash; the prefix sum of expected copies is then rank times
expectation. One random offset is added, and a document is emitted once for each integer
that the sum crosses at it. As neighbours are alike in size, the words taken stay near the
target whatever the offset; of a few equally likely offsets the one that comes nearest is used.

Ranks don't come from a window over a source: documents are dealt by source, step of size
and hash range, these are counted, and a rank is the number of documents in earlier steps
and ranges plus the rank in the own one. So a source that holds most rows spreads over
many tasks. Targets are found by resharing the excess of full sources in aggregates over
the table of sources, of which the driver sees three numbers a round.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.llm.common import lean, null_safe_join, released, scratch, stored, temporary
from tallyglass.llm.textcore import each_text

#: Weights of the sources in order, repeated as often as needed, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Offsets that are tried, equally spaced from a random one.
OFFSETS = 16
#: Documents that one hash range of one step of size holds at most, or so, beyond RANGES ranges.
RANGE_ROWS, RANGES = 1 << 20, 8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def n_words(raw: bytes, stretch: int = 1 << 22) -> int:
    """Words of a text, a stretch at a time."""
    n, gap = 0, True
    for i in range(0, len(raw), stretch):
        space = _SPACE[np.frombuffer(raw, np.uint8, min(stretch, len(raw) - i), i)]
        n += int(np.count_nonzero(space[:-1] & ~space[1:])) + int(gap and not space[0])
        gap = bool(space[-1])
    return n


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    return pa.array([n_words(raw or b"") for raw in each_text(text)], pa.int64())


def size_step(size: Column) -> Column:
    """Steps of sizes that grow by a sixteenth at most: exact below 32, then the five leading bits and their place."""
    shift = F.length(F.bin(size)) - 5
    return F.when(size < 32, size).otherwise(shift * 16 + F.call_function("shiftright", size, shift)).cast("int")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all sizes by weight, at most ``most`` times a source's size.

    Sources are weighed by their place in code point order, null last. Full sources keep their limit and what is above
    it goes to the others by weight, until none is above. A source without words has target 0.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = sources.orderBy(F.col("source").isNull(), "source").withColumn("__id", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("__part", F.shiftright("__id", 33)), "mix-sources")
    before = placed.groupBy("__part").agg(F.count("*").alias("n"))  # a row for each partition of the sort
    before = before.withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")
    rank = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    weighed = placed.join(F.broadcast(before), "__part").withColumn("__w", F.element_at(cycle, (rank % len(weights) + 1).cast("int")))
    weighed = stored(weighed.withColumn("__limit", F.col("source_size") * most).drop("__id", "__part", "__before"), "mix-weights")

    wide = lambda c: c.cast("decimal(19,0)")
    top, bottom, n_full = weighed.agg(F.sum("source_size"), F.sum("__w"), F.lit(0)).first()
    while bottom:
        # what a unit of weight gets is top / bottom; a source is full if that is its limit or more
        full = wide(F.col("__limit")) * F.lit(Decimal(bottom)).cast("decimal(19,0)") <= wide(F.col("__w")) * F.lit(Decimal(top)).cast("decimal(19,0)")
        held, open_weight, n, total = weighed.agg(F.sum(F.when(full, F.col("__limit"))), F.sum(F.when(~full, F.col("__w"))), F.count(F.when(full, 1)), F.sum("source_size")).first()
        if n == n_full:
            break
        top, bottom, n_full = total - (held or 0), open_weight or 0, n
    share = F.col("__w") * F.lit(float(top or 0)) / F.lit(float(bottom)) if bottom else F.lit(float("inf"))
    return weighed.select("source", "source_size", F.least(F.col("__limit").cast("double"), share).alias("target"))


def systematic(rank: Column, expected: Column, offset: Column) -> Column:
    """Integers that the prefix sum of ``expected`` crosses at the document of a rank (from 1)."""
    return F.floor(rank * expected + offset) - F.floor((rank - 1) * expected + offset)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 0, carry: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, source_size, target and copies for each row; with ``carry`` the whole row as struct ``row``.

    * A null text has size 0, a null source is a source of its own (the last), a null id is written as nothing.
    * A document's copies are its expectation rounded down or up, and so ``most`` at most; documents without words are dealt
      like others and take no words.
    * Rows equal in id and text are dealt one by one and are interchangeable; ties fall by the md5 of id and text.
    * Texts of any length are counted a stretch at a time; an empty table gives no rows; other columns are not read but for ``carry``.
    """
    spark = docs.sparkSession
    lean(spark)
    path = scratch(spark, "mix-ranks")  # outlives what is stored on the way to it
    with temporary(spark):
        ranked = _ranked(docs, weights, most, seed, carry, id_col, text_col, source_col, range_rows)
        ranked = released(ranked, "mix-ranks", path)

    tried = [((F.col("__u") + k / OFFSETS) % 1.0) for k in range(OFFSETS)]
    sums = ranked.groupBy("source").agg(F.first("target").alias("target"), F.array(*[F.sum(F.col("size") * systematic(F.col("__rank"), F.col("__e"), u)) for u in tried]).alias("sums"))
    off = F.transform("sums", lambda s, k: F.struct(F.abs(s - F.col("target")).alias("off"), k.alias("k")))
    best = sums.select("source", F.array_min(off)["k"].alias("__k"))
    chosen = _salted_join(ranked, best)
    copies = systematic(F.col("__rank"), F.col("__e"), (F.col("__u") + F.col("__k") / OFFSETS) % 1.0)
    return chosen.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"), *(["row"] if carry else []))


def _ranked(docs: DataFrame, weights: Sequence[int], most: int, seed: int, carry: bool, id_col: str, text_col: str, source_col: str, range_rows: int) -> DataFrame:
    """Each row with its rank ``__rank`` in its source, its expected copies ``__e`` and the source's offset ``__u``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")).alias("__h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    rows = stored(rows.withColumn("__step", size_step(F.col("size"))), "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    n_ranges = max(RANGES, rows.count() // range_rows)
    rows = rows.withColumn("__range", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * n_ranges / F.lit(2**32)).cast("int"))

    key = ["source", "__step", "__range"]
    ranges = rows.groupBy(*key).agg(F.count("*").alias("n"))
    steps = ranges.groupBy("source", "__step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source").orderBy("__step")
    steps = steps.select("source", "__step", (F.sum("n").over(w) - F.col("n")).alias("__steps_before"))
    w = Window.partitionBy("source", "__step").orderBy("__range")
    ranges = ranges.select(*key, (F.sum("n").over(w) - F.col("n")).alias("__ranges_before"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # the offset is a multiple of 2**-13, so that sums of whole expectations never round
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 3), 16, 10).cast("int") + 0.5) / 4096
    info = null_safe_join(null_safe_join(ranges, steps, ["source", "__step"]), sources.withColumn("__e", expected).withColumn("__u", offset), ["source"])
    # ranks come from a window by source, step and range, so no task holds a whole source
    own = F.row_number().over(Window.partitionBy(*key).orderBy("__h"))
    ranked = null_safe_join(rows.withColumn("__own", own), info, key)
    rank = F.col("__steps_before") + F.col("__ranges_before") + F.col("__own")
    return ranked.withColumn("__rank", rank).select("doc_id", "source", "size", "source_size", "target", "__rank", "__e", "__u", *(["row"] if carry else []))


def _salted_join(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """The rows with the columns of a table that has one row for each source.

    Rows of a source are first dealt over salts, so that a source with a third of all rows is not one task.
    """
    salts = 64
    left = rows.withColumn("__salt", (F.col("__rank") % salts).cast("int"))
    right = by_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(left, right, ["source", "__salt"]).drop("__salt")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every row as often as it is taken, numbered by ``mix_copy`` from 1."""
    taken = mix(docs, carry=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).select("row.*", F.col("__copy").alias("mix_copy"))


def op11(spark: SparkSession, d: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{d}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_STEP = "CASE WHEN size < 32 THEN size ELSE (length(bin(size)) - 5) * 16 + (size >> (length(bin(size)) - 5)) END"
_CROSSED = "CAST(floor(rank * e + {u}) - floor((rank - 1) * e + {u}) AS BIGINT)"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w FROM d GROUP BY source),
lift AS (  -- what a unit of weight gets, round by round
  SELECT 0 AS round, (SELECT sum(source_size) FROM s) AS top, (SELECT sum(w) FROM s) AS bottom
  UNION ALL
  SELECT round + 1, n_top, n_bottom FROM (
    SELECT round, top AS o_top, bottom AS o_bottom,
      (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s WHERE 3 * source_size * lift.bottom <= w * lift.top), 0) AS n_top,
      coalesce((SELECT sum(w) FROM s WHERE NOT 3 * source_size * lift.bottom <= w * lift.top), 0) AS n_bottom FROM lift)
  WHERE n_bottom > 0 AND (n_top <> o_top OR n_bottom <> o_bottom)),
unit AS (SELECT CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom FROM lift ORDER BY round DESC LIMIT 1),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * top / bottom) AS target,
    (CAST('0x' || substr(md5('0:' || coalesce(source, '')), 1, 3) AS INT) + 0.5::DOUBLE) / 4096 AS u FROM s, unit),
r AS (SELECT doc_id, size, source_size, target, u, d.source, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY {_STEP}, h) AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
tried AS (SELECT source, any_value(target) AS target, k, sum(size * {_CROSSED.format(u="(u + k / 16.0::DOUBLE) % 1.0::DOUBLE")}) AS taken FROM r, range(16) AS o(k) GROUP BY source, k),
best AS (SELECT source, arg_min(k, abs(taken - target) * 100 + k / 1e9) AS k FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target, size * {_CROSSED.format(u="(u + k / 16.0::DOUBLE) % 1.0::DOUBLE")} AS taken
FROM r JOIN best ON r.source IS NOT DISTINCT FROM best.source"""

QUERIES = {"op11_source_mixing": op11}
ORACLES = {"op11_source_mixing": ORACLE}
