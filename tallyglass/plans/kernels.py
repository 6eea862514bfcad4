"""Queries of the parsing kernels; SQL can't express them, tests/test_kernels.py and tests/test_operators.py check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.functions.text import split_sizes
from tallyglass.operators import extract
from tallyglass.plans import views as v
from tallyglass.plans.registry import query


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("bytes"))


@query("symbols_html")
def symbols_html(spark, d):
    return extract.listed(_pages(spark, d)).select("path", "type", "name", "start_line", "end_line", "container")


@query("definitions_html")
def definitions_html(spark, d):
    return extract.definitions(_pages(spark, d), "title").select("path", "name", "start_line", "end_line", "code")


@query("file_summary_html")
def file_summary_html(spark, d):
    out = extract.summary(_pages(spark, d))
    pairs = F.transform(F.array_sort(F.map_entries("symbol_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("path", "total_lines", F.array_join(pairs, ",").alias("symbol_counts"))


@query("split_text", f"""WITH RECURSIVE {v.FILES}, cut(path, part, n, rest) AS (
  SELECT path, 0, CAST(0 AS BIGINT), content FROM files
  UNION ALL SELECT path, part + 1, CAST(k AS BIGINT), substr(rest, k + 1) FROM (
    SELECT path, part, rest, CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN contains(substr(rest, 1, 1000), chr(10)) THEN 1001 - strpos(reverse(substr(rest, 1, 1000)), chr(10)) ELSE 1000 END AS k FROM cut WHERE rest <> ''))
  SELECT path, part - 1 AS part, n FROM cut WHERE part > 0""")  # fmt: skip
def split_text(spark, d):
    parts = v.files(spark, d).select("path", F.posexplode(split_sizes(F.col("content"), 1000)).alias("part", "p"))
    return parts.select("path", F.col("part").cast("long").alias("part"), F.col("p.length").cast("long").alias("n"))
