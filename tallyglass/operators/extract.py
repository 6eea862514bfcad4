"""Symbols, definitions, outlines, slices, summaries and syntax chunks of files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.languages import CHUNK_LANGUAGES, EXTRACT_LANGUAGES, lookup, symbol_type_matches
from tallyglass.functions.paths import extension
from tallyglass.kernels import declarations as decl
from tallyglass.kernels import slices as sl
from tallyglass.operators.chunk import resplit

_SYMBOL = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("start_line", "end_line", "start", "end")], T.StructField("container", T.StringType())]
)
_PARSED = T.StructType([T.StructField("symbols", T.ArrayType(_SYMBOL)), T.StructField("error", T.StringType())])
_KINDS = [(f, pa.string() if f in ("name", "type", "container") else pa.int64()) for f in decl.Symbol._fields]
#: Files whose symbols a task holds as Python objects.
ROWS = 256


def _read(text: str | None, language: str) -> tuple[list[decl.Symbol], str | None]:
    """The symbols of a text, or why it couldn't be read."""
    try:
        return decl.symbols(text or "", language), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], str(e)[:200]


def _pairs(content: pa.Array, language: pa.Array) -> Iterator[Iterator[tuple[str | None, str]]]:
    """Texts with their languages, in groups of ``ROWS``; a group is held at a time."""
    for i in range(0, len(content), ROWS):
        yield zip(content.slice(i, ROWS).to_pylist(), language.slice(i, ROWS).to_pylist(), strict=True)


@F.arrow_udf(_PARSED)
def _parse(content: pa.Array, language: pa.Array) -> pa.Array:
    parts = [pa.array([], pa.struct([("symbols", pa.list_(pa.struct(_KINDS))), ("error", pa.string())]))]
    for pairs in _pairs(content, language):
        found = [_read(text, lang) for text, lang in pairs]
        flat = [s for own, _ in found for s in own]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*flat, strict=True) if flat else [()] * len(_KINDS), _KINDS, strict=True)]
        offsets = pa.array(np.cumsum([0, *[len(own) for own, _ in found]], dtype=np.int32))
        symbols = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, [f for f, _ in _KINDS]))
        parts.append(pa.StructArray.from_arrays([symbols, pa.array([e for _, e in found], pa.string())], ["symbols", "error"]))
    return pa.concat_arrays(parts)


_parsed_once = _parse.asNondeterministic()  # else filters that Spark derives parse every file once more


def parsed(files: DataFrame) -> DataFrame:
    """``files`` with language, symbols and error (null where the file could be read)."""
    lang = lookup(EXTRACT_LANGUAGES, extension(F.col("path")))
    return files.withColumn("language", lang).where("language != ''").withColumn("__p", _parsed_once("content", "language")).withColumn("symbols", F.col("__p.symbols")).withColumn("error", F.col("__p.error")).drop("__p")


def exploded(files: DataFrame, *more: str, kept: Column | None = None) -> DataFrame:
    """path, language, the columns ``more``, and each symbol (or those in ``kept``) with its signature: the line that it begins in, from its start.

    The signature is cut from the text where it is asked for. In a file of one line each signature is the rest of the file.
    """
    rows = parsed(files).select("path", "language", "content", F.explode("symbols" if kept is None else kept).alias("s")).select("path", "language", "content", "s.*")
    line = F.substring_index(F.expr("substring(content, CAST(start AS INT) + 1)"), "\n", 1)
    ends = F.when(F.col("language").isin("html", "xml"), line).when(F.col("language") == "python", F.regexp_replace(line, r"(?U)\s+\z", "")).otherwise(F.regexp_replace(line, r"\r+\z", ""))
    return rows.select("path", "language", *more, *decl.Symbol._fields, ends.alias("signature"))


def _admitted(kinds: dict[str, str], kind: Column | None = None) -> Column:
    kind, out = F.col("type") if kind is None else kind, F.lit(False)
    for lang, names in kinds.items():
        out = out | ((F.col("language") == lang) & kind.isin(names.split()))
    return out


def listed(files: DataFrame, symbol_type: str = "", kinds: dict[str, str] = decl.LISTED) -> DataFrame:
    """path, language and the symbols that a listing shows, once for each span."""
    rows = exploded(files)
    return rows.where(_admitted(kinds)).where(symbol_type_matches(F.col("type"), symbol_type)).dropDuplicates(["path", "start", "end", "name"])


def warnings(files: DataFrame) -> DataFrame:
    """Files that couldn't be parsed, and why."""
    return parsed(files).where("error IS NOT NULL").select("path", "error")


def first_matches(symbols: DataFrame) -> DataFrame:
    """Of symbols of one name, the first in each file of a kind that can be extracted."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("start", F.desc("end")))
    return symbols.where(_admitted(decl.EXTRACTED)).withColumn("__r", first).where("__r = 1").drop("__r")


def definitions(files: DataFrame, symbol: str) -> DataFrame:
    """The first match in each file, in order of path: path, language, the symbol and its code."""
    # symbols are in order of start, so a file's first match is known before it is a row; texts stay behind when rows are ordered
    matches = F.filter("symbols", lambda s: (s["name"] == symbol) & _admitted(decl.EXTRACTED, s["type"]))
    code = F.expr("substring(content, CAST(start AS INT) + 1, CAST(end - start AS INT))")
    rows = exploded(files, "content", kept=F.slice(matches, 1, 1)).withColumn("code", code).drop("content")
    return first_matches(rows).orderBy("path")


def extract(files: DataFrame, symbol: str) -> DataFrame:
    """Like :func:`definitions`; no match at all is an error."""
    out = definitions(files, symbol)
    if out.isEmpty():
        raise LookupError(f"symbol {symbol!r} not found")
    return out


def members(files: DataFrame, owner: str) -> DataFrame:
    """Members of a class-like symbol: path, name, type, line, end_line, signature."""
    rows = listed(files, kinds=decl.EXTRACTED).where((F.col("container") == owner) & F.col("type").isin("function", "method", "constructor"))
    return rows.select("path", "language", F.lit(owner).alias("owner"), "name", "type", F.col("start_line").alias("line"), "end_line", "signature")


_COUNTED = T.StructType([T.StructField("counts", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("n", T.LongType())]))), T.StructField("error", T.StringType())])


@F.arrow_udf(_COUNTED)
def _count(content: pa.Array, language: pa.Array) -> pa.Array:
    """How many symbols of each type a listing of the file has."""
    rows = []
    for pairs in _pairs(content, language):
        for text, lang in pairs:
            found, error = _read(text, lang)
            kinds = decl.LISTED.get(lang, "").split()
            spans = {(s.start, s.end, s.name): s.type for s in reversed(found) if s.type in kinds}
            rows.append({"counts": [{"type": t, "n": n} for t, n in sorted(Counter(spans.values()).items())], "error": error})
    return pa.array(rows, pa.struct([("counts", pa.list_(pa.struct([("type", pa.string()), ("n", pa.int64())]))), ("error", pa.string())]))


_counted_once = _count.asNondeterministic()

def summary(files: DataFrame) -> DataFrame:
    """path, total_lines and symbols by type of each file that could be parsed; in one pass, without a shuffle."""
    lang = lookup(EXTRACT_LANGUAGES, extension(F.col("path")))
    rows = files.select("path", "content", lang.alias("language")).where("language != ''").withColumn("__c", _counted_once("content", "language"))
    total = F.size(F.split("content", "\n", -1)).cast("long")
    return rows.where("__c.error IS NULL").select("path", total.alias("total_lines"), F.map_from_entries("__c.counts").alias("symbol_counts"))


_SLICES = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("code", T.StringType())]))


@F.arrow_udf(_SLICES)
def _slices(content: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    rows = [[s._asdict() for s in sl.definition(t or "", a, b)] for t, a, b in zip(content.to_pylist(), start.to_pylist(), end.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([(f, pa.int64() if f in ("start", "end") else pa.string()) for f in sl.Slice._fields])))


def sliced(spans: DataFrame) -> DataFrame:
    """``spans`` (path, content, start_line, end_line) as slices."""
    out = spans.withColumn("s", F.explode(_slices("content", F.col("start_line").cast("long"), F.col("end_line").cast("long"))))
    return out.select("path", "s.*")


_CHUNKS = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("node_type", T.StringType()), T.StructField("content", T.StringType())]))


@F.arrow_udf(_CHUNKS)
def _chunks(content: pa.Array, language: pa.Array) -> pa.Array:
    """The declarations of a text as chunks; a text without any is one block."""
    rows = []
    for t, lang in zip(content.to_pylist(), language.to_pylist(), strict=True):
        t = t or ""
        rows.append([c._asdict() for c in decl.chunks(t, lang)] or [{"start_line": 1, "end_line": t.count("\n") + 1, "node_type": "block", "content": t}])
    return pa.array(rows, pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("node_type", pa.string()), ("content", pa.string())])))


def syntax_chunks(files: DataFrame, max_lines: int = 200, max_chars: int = 8192) -> DataFrame:
    """Outermost declarations as chunks of whole lines; a file without any, or unreadable, as line windows; oversize chunks re-split."""
    language = lookup(CHUNK_LANGUAGES, extension(F.col("path")))
    rows = files.select("path", F.explode(_chunks(F.col("content"), language)).alias("c")).select("path", "c.*")
    return resplit(rows, max_lines, max_chars, always=F.col("node_type") == "block")
