"""Freshness of an index: staleness, its description, and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import strip


def _clean(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def is_stale(has_meta: Column, commit: Column, fingerprint: Column, current_commit: Column, current_fingerprint: Column) -> Column:
    a, b, x, y = (_clean(c) for c in (commit, current_commit, fingerprint, current_fingerprint))
    return ~has_meta | (x == "") | (y == "") | (x != y) | (a == "") | (b == "") | (a != b)


def age(seconds: Column) -> Column:
    """A whole number of minutes, hours or days."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 60, F.lit("less than a minute"))
        .when(seconds < 3600, F.concat(whole(60), F.lit("m")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h")))
        .otherwise(F.concat(whole(86400), F.lit("d")))
    )


def describe(has_meta: Column, seconds: Column, files: Column, chunks: Column, commit: Column, fingerprint: Column, current_commit: Column, current_fingerprint: Column) -> Column:
    """'up to date', 'stale' with its reasons, or 'not indexed'."""
    a, b, x, y = (_clean(c) for c in (commit, current_commit, fingerprint, current_fingerprint))
    counts = F.concat(F.lit(" ("), files.cast("string"), F.lit(" files, "), chunks.cast("string"), F.lit(" chunks)"))
    short = lambda c: F.substring(c, 1, 7)
    head = (
        F.when(a == "", F.lit("missing indexed commit metadata"))
        .when(b == "", F.lit("current HEAD unavailable"))
        .when(a != b, F.concat(F.lit("HEAD is now "), short(b)))
    )
    rules = (
        F.when(x == "", F.lit("missing indexed ignore metadata"))
        .when(y == "", F.lit("current ignore rules unavailable"))
        .when(x != y, F.lit("ignore rules changed"))
    )
    reasons = F.concat_ws(" and ", head, rules)
    when = age(F.floor(seconds / 60) * 60)
    moved = (a != "") & (b != "") & (a != b)
    at = F.when(moved, F.concat(F.lit(" at "), short(a))).otherwise(F.lit(""))
    fresh = F.concat(F.lit("up to date — indexed "), when, F.lit(" ago"), counts)
    stale = F.concat(F.lit("stale — indexed "), when, F.lit(" ago"), at, F.lit(", "), reasons, counts)
    return F.when(~has_meta, F.lit("not indexed")).when(reasons == "", fresh).otherwise(stale)
