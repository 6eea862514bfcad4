"""The innermost span around a place: an interval stabbing join.

A span of up to 2**WIDE lines lies in one or two aligned cells of that many lines; places and such
spans meet by equality of (path, cell), each shuffled once: a cell's distinct places (2**WIDE at
most) go as one array, and what is innermost is settled where they meet. A longer span of length n
lies in one or two aligned bins of the power of two that is n or the next above; a place lies in
one bin of each such width, and as a file has few of them, they are dealt over salts as well.
So only the spans around a place are kept: no nested loop, and a file of many places is many keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.storage import shuffles_released

#: Longer spans than this power of two are joined by their width; a bin's places are then dealt over so many salts.
WIDE, SALTS = 10, 16


def enclosing(points: DataFrame, spans: DataFrame, path: str = "path", at: str = "line", start: str = "start_line", end: str = "end_line", carry: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """path, at, and start, end and ``carry`` of the innermost span around each distinct place that is in one.

    A span holds its first and last line (``strict``: only what is between them). The innermost is the shortest, of these
    the one that begins last, then the least by ``carry``. Spans that end before they begin, and nulls, meet nothing.
    """
    ends = lambda of: (of(start).cast("long"), of(end).cast("long")) if not strict else (of(start).cast("long") + 1, of(end).cast("long") - 1)
    a, b = ends(F.col)
    length = b - a + 1
    width = F.when(length <= 1 << WIDE, 0).otherwise(F.length(F.bin(length - 1))).cast("int")
    # columns stay flat until places are met: fewer bytes to shuffle
    named = {f"__{i}": c for i, c in enumerate((start, end, *carry))}
    cut = spans.where(a <= b).select(F.col(path).alias("__path"), width.alias("__w"), a.alias("__a"), b.alias("__b"), *[F.col(c).alias(k) for k, c in named.items()])
    place = points.select(F.col(path).alias("__path"), F.col(at).cast("long").alias("__at"))
    with shuffles_released(spans.sparkSession):
        widths = sorted(r[0] for r in cut.select("__w").distinct().collect())  # 54 numbers at most
    met_a, met_b = ends(lambda c: F.col("__0" if c == start else "__1"))
    order = F.struct((met_b - met_a).alias("n"), (-met_a).alias("a"), F.struct(*[F.col(k).alias(c) for k, c in named.items()]).alias("s"))
    around = F.col("__at").between(met_a, met_b)
    two = lambda w: F.explode(F.array_distinct(F.array(_shifted("__a", w), _shifted("__b", w)))).alias("__bin")
    key = ["__path", "__bin"]

    narrow = cut.where("__w = 0").select("__path", two(F.lit(WIDE)), *named)
    cells = place.where("__path IS NOT NULL AND __at IS NOT NULL").groupBy("__path", _shifted("__at", F.lit(WIDE)).alias("__bin")).agg(F.collect_set("__at").alias("__at"))
    met = cells.select(*key, F.explode("__at").alias("__at")).join(narrow, key).where(around)
    # (path, cell) are keys of the join, so this is no further shuffle
    best = met.groupBy(*key, "__at").agg(F.min(order).alias("__best")).drop("__bin")
    wide = [w for w in widths if w > 0]
    if wide:
        key = [*key, "__w", "__salt"]
        long = cut.where("__w > 0").select("__path", "__w", two(F.col("__w")), *named).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = place.distinct().withColumn("__w", F.explode(F.array(*[F.lit(w) for w in wide]))).withColumn("__bin", _shifted("__at", F.col("__w")))
        met = dealt.withColumn("__salt", F.pmod(F.xxhash64("__at"), F.lit(SALTS)).cast("int")).join(long, key).where(around)
        best = best.unionByName(met.groupBy(*key, "__at").agg(F.min(order).alias("__best")).drop("__bin", "__w", "__salt")).groupBy("__path", "__at").agg(F.min("__best").alias("__best"))
    return best.select(F.col("__path").alias(path), F.col("__at").alias(at), "__best.s.*")


def _shifted(c: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(c), by)
