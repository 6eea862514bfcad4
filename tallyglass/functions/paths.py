"""Path arithmetic on slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The path without its last segment; '.' where there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """The lower-cased extension with its dot, or ''."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def is_test_file(path: Column) -> Column:
    base = base_name(path)
    ends = F.lit(False)
    for suffix in ("_test.go", ".test.ts", ".test.js", "_test.py"):
        ends = ends | base.endswith(suffix)
    return ends | base.startswith("test_") | path.contains("/test/") | path.contains("/tests/")


def proximity(path: Column, definition: Column) -> Column:
    """2 x shared leading segments / segments of the definition's path; 0 if none is shared."""
    d = F.split(definition, "/")
    pairs = F.zip_with(F.split(path, "/"), d, lambda a, b: a.eqNullSafe(b) & b.isNotNull())
    state = F.aggregate(
        pairs, F.struct(F.lit(True).alias("going"), F.lit(0).alias("n")),
        lambda s, same: F.struct((s["going"] & same).alias("going"), F.when(s["going"] & same, s["n"] + 1).otherwise(s["n"]).alias("n")),
    )
    return F.lit(2.0) * state["n"] / F.size(d)


def relative_to(path: Column, root: str) -> Column:
    """The path below ``root``, or the path itself where it isn't below."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1_000_000)).otherwise(path)


def in_scope(path: Column, scope: str) -> Column:
    """Equal to the scope or below it; an empty scope admits all."""
    s = scope.rstrip("/")
    return F.lit(True) if not s else (path == s) | path.startswith(s + "/")


def extension_list(csv: Column) -> Column:
    """The extensions in a comma list, each with a dot; blank ones are left out."""
    parts = F.filter(F.transform(F.split(csv, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.startswith("."), x).otherwise(F.concat(F.lit("."), x)))


def ancestors(path: Column) -> Column:
    """The folders above a path, from the outermost."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, n), "/")))


def nearest_roots(files: DataFrame, marks: DataFrame) -> DataFrame:
    """path, root: the deepest marked folder (``marks``: dir) above each of ``files`` (path), else its own folder.

    Files meet marks by equality with the folders above them.
    """
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).join(marks.select("dir").distinct(), "dir")
    found = above.groupBy("path").agg(F.max_by("dir", F.length("dir")).alias("root"))
    return files.select("path").distinct().join(found, "path", "left").withColumn("root", F.coalesce("root", directory(F.col("path"))))


def path_to_uri(path: Column) -> Column:
    """A file URI of an absolute path: reserved characters as %XX, letters, digits and ``-._~!$&'()*+,;=:@/`` as they are."""
    coded = F.url_encode(path)
    kept = {"%2F": "/", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "=", "%3A": ":", "%40": "@", "%7E": "~"}
    coded = F.replace(coded, F.lit("+"), F.lit("%20"))
    for code, char in kept.items():
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.concat(F.lit("file://"), coded)


def uri_to_path(uri: Column) -> Column:
    """The path of a file URI, decoded, a ``+`` kept; other texts come back as they are, also those that can't be decoded."""
    coded = F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file://"), F.coalesce(F.try_url_decode(coded), uri)).otherwise(uri)
