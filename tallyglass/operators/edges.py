"""Call edges and type edges read from source code.

Names decide: a call belongs to every declared function of its name, whatever the type of its receiver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.languages import EXTRACT_LANGUAGES, lookup
from tallyglass.functions.paths import extension
from tallyglass.kernels import relations as rel
from tallyglass.operators import containment, extract
from tallyglass.operators.enclosing import enclosing
from tallyglass.storage import remove, stored

_KINDS = {str: (T.StringType(), pa.string()), int: (T.LongType(), pa.int64()), bool: (T.BooleanType(), pa.bool_())}
_ROWS = {"calls": {"caller": str, "callee": str, "line": int, "declared": int}, "supers": {"name": str, "parent": str, "line": int}, "members": {"owner": str, "name": str, "line": int, "required": bool}}
_SPARK = T.StructType([T.StructField(k, T.ArrayType(T.StructType([T.StructField(f, _KINDS[t][0]) for f, t in fields.items()]))) for k, fields in _ROWS.items()])
_ARROW = pa.struct([(k, pa.list_(pa.struct([(f, _KINDS[t][1]) for f, t in fields.items()]))) for k, fields in _ROWS.items()])


@F.arrow_udf(_SPARK)
def _related(content: pa.Array, language: pa.Array) -> pa.Array:
    rows = []
    for text, lang in zip(content.to_pylist(), language.to_pylist(), strict=True):
        try:
            found = rel.relations(text or "", lang)
        except (SyntaxError, ValueError, RecursionError):
            found = rel.Relations([], [], [])
        rows.append({k: [r._asdict() for r in getattr(found, k)] for k in _ROWS})
    return pa.array(rows, _ARROW)


def related(files: DataFrame) -> DataFrame:
    """path, language and the calls, supers and members of each file as lists: one parse for all."""
    language = lookup(EXTRACT_LANGUAGES, extension(F.col("path")))
    read = files.select("path", "content", language.alias("language")).where("language != ''")
    return read.select("path", "language", _related("content", "language").alias("r")).select("path", "language", "r.*")


def _rows(files: DataFrame, kind: str) -> DataFrame:
    return related(files).select("path", "language", F.explode(kind).alias("r")).select("path", "language", "r.*")


def calls(files: DataFrame) -> DataFrame:
    """path, language, caller, callee, line of each call inside a named function, and the line that declares the caller; unreadable files have none."""
    return _rows(files, "calls")


def call_edges(files: DataFrame) -> DataFrame:
    """caller, callee, path, line: the first place of each call between names that ``files`` declare."""
    declared = extract.parsed(files).select(F.explode("symbols").alias("s")).where(F.col("s.type").isin("function", "method", "constructor", "class", "struct"))
    known = declared.select(F.col("s.name").alias("callee")).distinct()
    first = calls(files).groupBy("caller", "callee").agg(F.min(F.struct("path", "line")).alias("at"))
    return first.join(known, "callee", "left_semi").select("caller", "callee", "at.path", "at.line")


#: A line that is nothing but a type's name: what a struct or interface embeds.
_EMBEDDED = r"^\s*\*?(?:[A-Za-z_]\w*\.)?([A-Za-z_]\w*)(?:\[[^\]]*\])?\s*(?:`[^`]*`)?\s*(?://.*)?$"


def go_embeds(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, owner, kind, part: the types that Go structs and interfaces (``kind``) embed, from lines inside their innermost declaration."""
    go = files.where(F.lower(F.col("path")).endswith(".go")).select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
    named = go.select("path", (F.col("at") + 1).cast("long").alias("line"), F.regexp_extract("text", _EMBEDDED, 1).alias("part")).where("part <> ''")
    around = enclosing(named, symbols.where(F.lower(F.col("path")).endswith(".go")), carry=["name", "type"], strict=True)
    return named.join(around.where(F.col("type").isin("struct", "interface")), ["path", "line"]).select("path", F.col("name").alias("owner"), F.col("type").alias("kind"), "part").distinct()


def implemented(supers: DataFrame, members: DataFrame, embeds: DataFrame) -> DataFrame:
    """super, sub, path, line: supertypes that declarations name, and the Go interfaces whose methods a type all has.

    Methods count that a struct or interface has by embedding, at any depth. Which types hold an interface's methods is a
    join of sets by containment. ``path`` and ``line`` are those of the first of these methods.
    """
    spark, held = members.sparkSession, []
    named = supers.select(F.col("parent").alias("super"), F.col("name").alias("sub"), "path", "line")
    go = stored(members.where("language = 'go'").select("owner", "name", "path", "line", "required"), "go-members", held)
    faces = go.where("required").select("owner").unionByName(embeds.where("kind = 'interface'").select("owner")).distinct()
    every = stored(containment.embedded(go, embeds), "method-sets", held)
    wanted = stored(every.join(faces, "owner", "left_semi"), "method-sets", held)
    has = every.join(faces, "owner", "left_anti")
    rows = lambda df: df.select(F.col("owner").alias("set_id"), F.col("name").alias("element"))
    pairs = containment.contained(rows(wanted), rows(has)).select(F.col("small_id").alias("super"), F.col("large_id").alias("sub"))
    places = go.where("NOT required").groupBy("name", "owner").agg(F.min(F.struct("path", "line")).alias("at"))
    own = places.select(F.col("owner").alias("sub"), "name", "at")
    asked = wanted.select(F.col("owner").alias("super"), "name")
    # methods of its own place a pair; one that has them all by embedding stands where the embedded type has its first
    at = pairs.join(asked, "super").join(own, ["sub", "name"], "left").groupBy("super", "sub").agg(F.min("at").alias("at"))
    any_place = places.groupBy("name").agg(F.min("at").alias("any"))
    elsewhere = at.where("at IS NULL").join(asked, "super").join(any_place, "name").groupBy("super", "sub").agg(F.min("any").alias("at"))
    full = at.where("at IS NOT NULL").unionByName(elsewhere).select("super", "sub", "at.path", "at.line")
    out = stored(named.unionByName(full).dropDuplicates(["super", "sub", "path", "line"]), "type-edges")
    remove(spark, held)
    return out


def type_edges(files: DataFrame) -> DataFrame:
    """:func:`implemented` read from ``files``."""
    held: list[str] = []
    found = stored(related(files), "related", held)
    rows = lambda kind: found.select("path", "language", F.explode(kind).alias("r")).select("path", "language", "r.*")
    symbols = extract.parsed(files.where(F.lower(F.col("path")).endswith(".go"))).select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    out = implemented(rows("supers"), rows("members"), go_embeds(files, symbols))
    remove(files.sparkSession, held)
    return out
