"""The virtual repository over the test tables, for Spark and (as CTEs) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.sources import files as src

_CASES = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(src.DOCUMENT_SUFFIXES))
FILES = f"""files AS (
  SELECT source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 10 {_CASES} END AS path,
         text AS content, CAST(strlen(text) AS BIGINT) AS bytes, doc_id
  FROM documents)"""
LINES = """lines AS (
  SELECT path, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS snippet
  FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"""
EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
BASE = "regexp_extract(path, '([^/]*)$', 1)"
DIR = "CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END"


def squeeze(c: str) -> str:
    """Trimmed, white space collapsed."""
    return f"regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return src.from_documents(documents(spark, d))


def numbered_files(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and path of the files."""
    return files(spark, d).select(F.regexp_extract("path", r"doc_(\d+)", 1).cast("long").alias("doc_id"), "path")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return src.lines(files(spark, d)).withColumn("line", F.col("line").cast("long"))


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """A heap over parts: p calls p div 2; 0 calls itself."""
    p = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select(p.alias("caller"), F.expr("p_partkey div 2").alias("callee"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers call their parts and parts their suppliers: full of cycles."""
    pairs = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b")
    ).distinct()
    return pairs.select(F.col("a").alias("caller"), F.col("b").alias("callee")).unionByName(pairs.select(F.col("b").alias("caller"), F.col("a").alias("callee")))


SUPPLY_EDGES = """pairs AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'p' || CAST(l_partkey AS VARCHAR) AS b FROM lineitem),
edges AS (SELECT a AS caller, b AS callee FROM pairs UNION ALL SELECT b, a FROM pairs)"""


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Events as diagnostics: the user is the file, the type gives the severity."""
    severity = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "click", 2).otherwise(3)
    return spark.read.parquet(f"{d}/events.parquet").select(
        "event_id", "ts", F.col("user_id").alias("uri"), severity.alias("severity"), F.col("props").alias("message"), (F.col("event_id") % 7).alias("line"), (F.col("event_id") % 3).alias("character")
    )


DIAGNOSTICS = """diags AS (
  SELECT event_id, ts, user_id AS uri, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 0 WHEN 'click' THEN 2 ELSE 3 END AS severity,
         props AS message, event_id % 7 AS line, event_id % 3 AS character
  FROM events)"""


def part_symbols(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in (5, 6, 9, 10, 11, 12, 14, 23)])
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", F.col("p_name").alias("name"), F.element_at(kinds, F.col("p_size") % 8 + 1).alias("kind"), F.col("p_brand").alias("container"), F.concat(F.lit("src/"), "p_type").alias("path")
    )


PART_SYMBOLS = """symbols AS (
  SELECT p_partkey, p_name AS name, [5, 6, 9, 10, 11, 12, 14, 23][p_size % 8 + 1] AS kind, p_brand AS container, 'src/' || p_type AS path FROM part)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Members of classes made of line items: an order is a class, its items are members."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(
        F.col("l_orderkey").alias("owner"), F.concat(F.when(F.col("l_partkey") % 11 == 0, "New").otherwise("run"), F.lit("_"), F.col("l_partkey").cast("string")).alias("name"),
        (F.col("l_linenumber") * F.col("l_linenumber") * 13).cast("long").alias("line"), (F.col("l_linenumber") * F.col("l_linenumber") * 13 + F.col("l_partkey") % 45).cast("long").alias("end_line"),
        F.when(F.col("l_suppkey") % 2 == 0, "public").otherwise("private").alias("visibility"), F.when(F.col("l_suppkey") % 13 == 0, "constructor").otherwise("method").alias("kind"),
    )


MEMBERS = """members AS (
  SELECT l_orderkey AS owner, CASE WHEN l_partkey % 11 = 0 THEN 'New' ELSE 'run' END || '_' || CAST(l_partkey AS VARCHAR) AS name,
         CAST(l_linenumber * l_linenumber * 13 AS BIGINT) AS line, CAST(l_linenumber * l_linenumber * 13 + l_partkey % 45 AS BIGINT) AS end_line,
         CASE WHEN l_suppkey % 2 = 0 THEN 'public' ELSE 'private' END AS visibility, CASE WHEN l_suppkey % 13 = 0 THEN 'constructor' ELSE 'method' END AS kind
  FROM lineitem)"""


def literals(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(names: str, rows: list[tuple]) -> str:
    """The same rows as an SQL VALUES table."""

    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"
