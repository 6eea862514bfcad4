"""Ignore rules as compiled predicates.

Every pattern becomes one regular expression, so a rule set is a single ``rlike``
that runs inside code generation. Two forms exist: a walk leaves out everything
below an ignored directory, while a bare path is only tested itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import strip

# fixed values: patterns that hold everywhere
DEFAULT_PATTERNS = ".git node_modules vendor dist build .next __pycache__ .pytest_cache .mypy_cache target .idea .vscode .DS_Store".split()


def normalise(raw: str) -> str | None:
    """A pattern without blanks, one trailing slash and a leading ``./``; None for comments, negations and nothing."""
    p = raw.strip()
    if not p or p[0] in "#!":
        return None
    p = p.removesuffix("/").removeprefix("./")
    return p or None


def normalised(raw: Column) -> Column:
    """:func:`normalise` for a column: null for comments, negations and nothing."""
    p = strip(raw)
    cut = F.regexp_replace(F.regexp_replace(p, "/$", ""), r"^\./", "")
    return F.when((p != "") & ~p.rlike("^[#!]") & (cut != ""), cut)


def rule_set(extra: Iterable[str] = (), *files: str) -> list[str]:
    """Defaults, extra patterns and the lines of ignore files, in order, each once."""
    raw = [*DEFAULT_PATTERNS, *extra, *(line for text in files for line in text.split("\n"))]
    return list(dict.fromkeys(p for p in map(normalise, raw) if p))


def fingerprint(patterns: Iterable[str]) -> str:
    return hashlib.sha256("\0".join(sorted(patterns)).encode()).hexdigest()


def _glob(pattern: str) -> str:
    """A shell pattern as a regular expression: * and ? stay within a segment, classes are kept."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += pattern[i : end + 1]
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def pattern_regex(pattern: str, walk: bool = False) -> str:
    """The regular expression of one pattern, to be searched in a relative path."""
    anchored = pattern.startswith("/")
    p = pattern.lstrip("/") if anchored else pattern
    glob = any(c in p for c in "*?[")
    start = "^" if anchored and "/" in p else "(^|/)"
    if glob:
        return f"{start}{_glob(p)}" + ("(/|$)" if walk else "$")
    return f"{start}{re.escape(p)}(/|$)"


def regex(patterns: Iterable[str], walk: bool = False) -> str:
    return "|".join(pattern_regex(p, walk) for p in patterns)


def ignored(path: Column, patterns: Iterable[str], walk: bool = False) -> Column:
    """Whether a relative path is ignored; '.' and paths outside the root ('../') never are."""
    joined = regex(patterns, walk)
    if not joined:
        return F.lit(False)
    return path.rlike(joined) & (path != ".") & ~path.startswith("../")
