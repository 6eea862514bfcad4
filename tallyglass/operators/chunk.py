"""Line windows, and the re-splitting of chunks that are too large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.text import lines, strip

SIZE, OVERLAP = 80, 10


def window_step(size: int, overlap: int) -> tuple[int, int, int]:
    """Valid size and overlap, and the step between windows."""
    size = size if size > 0 else SIZE
    overlap = max(overlap, 0)
    if overlap >= size:
        overlap = size // 4
    return size, overlap, size - overlap


def _cut(all_lines: Column, size: int, overlap: int) -> Column:
    """The windows of an array of lines as an array of (first, last, text); the array is bound once, not copied into each window."""
    size, overlap, step = window_step(size, overlap)

    def each(ls: Column) -> Column:
        n = F.size(ls)
        starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i + overlap < n))
        return F.transform(starts, lambda i: F.struct((i + 1).alias("first"), F.least(i + size, n).alias("last"), F.array_join(F.slice(ls, i + 1, F.lit(size)), "\n").alias("text")))

    return F.flatten(F.transform(F.array(all_lines), each))


def windows(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """path, start_line, end_line, content, node_type for windows of lines.

    The window that reaches the end is the last; windows of white space only are left out.
    """
    out = files.select("path", F.explode(_cut(lines(F.col("content")), size, overlap)).alias("w"))
    out = out.select("path", F.col("w.first").alias("start_line"), F.col("w.last").alias("end_line"), F.col("w.text").alias("content"), F.lit("block").alias("node_type"))
    return out.where(strip(F.col("content")) != "")


def resplit(chunks: DataFrame, max_lines: int = 200, max_chars: int = 8192, size: int = SIZE, overlap: int = OVERLAP, always: Column | None = None) -> DataFrame:
    """Chunks beyond either limit (and those that ``always`` names) as line windows of their own, with shifted lines and their node type."""
    n = F.size(lines(F.col("content")))
    big = (n > max_lines) | (F.length("content") > max_chars)
    big = big if always is None else big | always
    whole = F.array(F.struct(F.lit(1).alias("first"), n.alias("last"), F.col("content").alias("text")))
    out = chunks.withColumn("__w", F.explode(F.when(big, _cut(lines(F.col("content")), size, overlap)).otherwise(whole)))
    first = F.col("start_line") - 1
    out = out.select("path", (first + F.col("__w.first")).alias("start_line"), (first + F.col("__w.last")).alias("end_line"), F.col("__w.text").alias("content"), "node_type")
    return out.where(strip(F.col("content")) != "")
