"""Identifiers and fingerprints made of SHA-256 prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefix(c: Column, hex_digits: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, hex_digits)


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """32 hex digits of ``path:start-end``."""
    return _prefix(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")), 32)


def collection_name(project: Column, override: Column | None = None, prefix: str = "code_") -> Column:
    """A trimmed override, else the prefix and 16 hex digits of the project's path."""
    own = F.concat(F.lit(prefix), _prefix(project, 16))
    if override is None:
        return own
    return F.coalesce(F.nullif(F.regexp_replace(override, r"^\s+|\s+$", ""), F.lit("")), own)


def state_key(root: Column, language: Column) -> Column:
    return _prefix(F.concat(root, F.lit("\0"), language), 16)


def rows_fingerprint(parts: Column) -> Column:
    """Of a group's strings, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)


def content_cut(c: Column, most: int = 65_535) -> Column:
    return F.substring(c, 1, most)


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, to compare by; null where a part isn't a number."""
    return F.when(version.rlike("^[0-9]+([.][0-9]+)*$"), F.transform(F.split(version, "[.]"), lambda x: x.cast("int")))
