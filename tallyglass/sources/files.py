"""Files as DataFrames: from a directory tree, or from a table of documents.

A file row is path (relative, with slashes), content, bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.functions import ignore, paths
from tallyglass.functions.languages import CHUNK_LANGUAGES, DEFAULT_EXTENSIONS, EXTRACT_LANGUAGES, SERVED_LANGUAGES, lookup
from tallyglass.functions.text import lines as split_lines

# fixed values: extensions that documents are given in turn
DOCUMENT_SUFFIXES = (".go", "_test.go", ".py", ".java", ".ts", ".rs", ".cpp", ".md", ".yaml", ".kts")
CHECK_FILE_LIMIT = 50


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Every regular file below ``root``; unreadable ones are skipped. Content is only read if it is used.

    Bytes that aren't UTF-8 become U+FFFD, so binary and Latin-1 files are rows like any others.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(root)
    prefix = "^(?:[a-zA-Z]+:)?/*" + "/".join(_quoted(p) for p in root.split(":", 1)[-1].strip("/").split("/")) + "/"
    return raw.select(F.regexp_replace("path", prefix, "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("bytes"))


def _quoted(segment: str) -> str:
    import re

    return re.escape(segment)


def from_documents(docs: DataFrame) -> DataFrame:
    """A virtual tree: source/lang/doc_<id><suffix by id>."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in DOCUMENT_SUFFIXES]), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix)
    return docs.select(path.alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("bytes"))


def walk(files: DataFrame, patterns: Sequence[str] = (), extensions: Iterable[str] = DEFAULT_EXTENSIONS, max_kb: int = 0) -> DataFrame:
    """Files that a walk takes: not ignored, of a known extension, within the size; in order of path."""
    out = files.where(~ignore.ignored(F.col("path"), patterns, walk=True)) if patterns else files
    out = out.where(paths.extension(F.col("path")).isin([e.lower() for e in extensions]))
    if max_kb > 0:
        out = out.where(F.col("bytes") <= max_kb * 1024)
    return out.orderBy("path")


def extract_scan(files: DataFrame, patterns: Sequence[str] = (), language: str = "") -> DataFrame:
    """Files that symbols can be extracted from, with their language."""
    out = files.where(~ignore.ignored(F.col("path"), patterns, walk=True)) if patterns else files
    out = out.withColumn("language", lookup(EXTRACT_LANGUAGES, paths.extension(F.col("path")))).where("language != ''")
    return (out.where(F.col("language") == language) if language else out).orderBy("path")


def list_scan(files: DataFrame, patterns: Sequence[str] = (), language: str = "") -> DataFrame:
    """Like :func:`extract_scan`; no file at all is an error."""
    out = extract_scan(files, patterns, language)
    if out.isEmpty():
        raise FileNotFoundError("no supported files")
    return out


def check_scan(files: DataFrame, language: str, patterns: Sequence[str] = (), limit: int = CHECK_FILE_LIMIT) -> DataFrame:
    """The files of one language, in order; more than ``limit`` are an error."""
    out = extract_scan(files, patterns, language)
    if out.select("path").limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} files to check; name a smaller scope")
    return out


def lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), snippet of every text file; a file with a NUL is binary and has none."""
    text = files.where(~F.col("content").contains("\0"))
    return text.select("path", F.posexplode(split_lines(F.col("content"))).alias("at", "snippet")).select("path", (F.col("at") + 1).alias("line"), "snippet")


def snippets(places: DataFrame, all_lines: DataFrame) -> DataFrame:
    """``places`` (path, line) with the text of the line; '' where there is none."""
    return places.join(all_lines, ["path", "line"], "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def language_counts(files: DataFrame) -> DataFrame:
    """Files by language, among languages that have a server."""
    lang = lookup(EXTRACT_LANGUAGES, paths.extension(F.col("path")))
    return files.select(lang.alias("language")).where(F.col("language").isin(SERVED_LANGUAGES)).groupBy("language").count()


def dominant_language(files: DataFrame) -> DataFrame:
    """The most frequent language; ties fall to the first by name. Empty if there is none."""
    return language_counts(files).orderBy(F.desc("count"), "language").limit(1)


def prime_file(files: DataFrame, language: str) -> DataFrame:
    """The first file of a language, by path."""
    return files.where(lookup(EXTRACT_LANGUAGES, paths.extension(F.col("path"))) == language).agg(F.min("path").alias("path"))


def guards(files: DataFrame, max_bytes: int = 500 * 1024, max_lines: int = 500) -> DataFrame:
    """path, total_lines, and status: file_too_large beyond either limit, else ok."""
    n = F.size(split_lines(F.col("content")))
    return files.select("path", n.alias("total_lines"), F.when((F.col("bytes") > max_bytes) | (n > max_lines), "file_too_large").otherwise("ok").alias("status"))


def chunk_language(path):
    return lookup(CHUNK_LANGUAGES, paths.extension(path))
