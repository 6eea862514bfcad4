"""References: finding, grouping, scoring and cross-checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions import paths
from tallyglass.functions.text import is_import, one_line, strip

# fixed values: weights of the features
DIRECT_CALL, SAME_PLACE, TEST_ANCHOR, DUPLICATE_PENALTY, DUPLICATE_FILES = 3.0, 2.0, 1.0, 2.0, 2


def grep(all_lines: DataFrame, term: str) -> DataFrame:
    """Distinct (path, line, snippet) of the lines that contain ``term``; ignores scope and kind."""
    return all_lines.where(F.col("snippet").contains(term)).select("path", "line", one_line(F.col("snippet")).alias("snippet")).dropDuplicates(["path", "line", "snippet"])


def find(files: DataFrame, term: str) -> DataFrame:
    """:func:`grep` over whole files: those without the term are dropped before they are cut into lines."""
    from tallyglass.sources.files import lines

    return grep(lines(files.where(F.col("content").contains(term))), term)


def with_lines(places: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (path, line, snippet) of ``places`` (path, line): only files that have one are cut into lines."""
    from tallyglass.sources.files import lines

    wanted = places.select("path", F.col("line").cast("int").alias("line")).distinct()
    own = lines(files.join(wanted.select("path").distinct(), "path", "left_semi"))
    return own.join(wanted, ["path", "line"]).select("path", "line", one_line(F.col("snippet")).alias("snippet"))


def by_path(refs: DataFrame) -> DataFrame:
    """References per path, and their lines in order."""
    return refs.groupBy("path").agg(F.count("*").alias("n_refs"), F.array_join(F.transform(F.array_sort(F.collect_list("line")), lambda x: x.cast("string")), ",").alias("lines"))


def _reasons(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), " + ")


def scored(refs: DataFrame, definition: Column, in_file: Column, call: Column) -> DataFrame:
    """``refs`` with score and reason, against a definition file; ``in_file`` is the number of references in a row's file, ``call`` says that its line has a bracket."""
    d, path = definition, F.col("path")
    same = path == d
    package = ~same & (paths.directory(path) == paths.directory(d))
    test = paths.is_test_file(path)
    total = (
        F.when(call, DIRECT_CALL).otherwise(0.0) + F.when(same | package, SAME_PLACE).otherwise(0.0) + F.when(d == "", 0.0).otherwise(paths.proximity(path, d))
        + F.when(test, TEST_ANCHOR).otherwise(0.0) - F.when(in_file > DUPLICATE_FILES, DUPLICATE_PENALTY).otherwise(0.0)
    )
    reason = _reasons(F.when(call, F.lit("direct call")), F.when(same, F.lit("same file")).when(package, F.lit("same package")), F.when(test, F.lit("test anchor")))
    return refs.withColumn("score", F.round(total, 6)).withColumn("reason", reason)


def score(refs: DataFrame, definition: Column | str) -> DataFrame:
    """:func:`scored` against one definition file; files with many references are marked down."""
    return scored(refs, F.lit(definition) if isinstance(definition, str) else definition, F.count("*").over(Window.partitionBy("path")), F.col("snippet").contains("("))


def top(scored: DataFrame, k: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "path", "line", "snippet").limit(k)


def score_callers(callers: DataFrame, definition: str) -> DataFrame:
    """``callers`` (name, path, line, depth) with score."""
    path, d = F.col("path"), F.lit(definition)
    near = (path == d) | (paths.directory(path) == paths.directory(d))
    total = F.lit(DIRECT_CALL) + F.when(near, SAME_PLACE).otherwise(0.0) + paths.proximity(path, d) + F.when(F.col("depth") <= 1, TEST_ANCHOR).otherwise(0.0)
    return callers.withColumn("score", F.round(total, 6))


def without_imports(refs: DataFrame) -> DataFrame:
    return refs.where(~is_import(F.col("snippet")))


def cross_check(refs: DataFrame, declarations: DataFrame) -> DataFrame:
    """References that are neither the declaration itself nor an import."""
    return without_imports(refs).join(declarations.select("path", "line"), ["path", "line"], "left_anti")


def cross_check_note(refs: DataFrame, declarations: DataFrame, listed: int = 5) -> DataFrame:
    """One row: how many such references, the first ones as path:line, and how many more there are."""
    left = cross_check(refs, declarations)
    places = left.orderBy("path", "line").limit(listed).select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("place"), "path", "line")
    shown = places.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "place"))), lambda s: s["place"]), ", ").alias("shown"))
    total = left.agg(F.count("*").alias("total"))
    return total.join(F.broadcast(shown), F.lit(True)).select("total", "shown", F.greatest(F.col("total") - listed, F.lit(0)).alias("more"))


def priority_fallback(candidates: DataFrame, key: str = "query_id", priority: str = "priority", broadcast_keys: bool = False) -> DataFrame:
    """The rows of each key's first source that gave any: a chain of fallbacks as one plan.

    The least priority of each key is joined back; ``broadcast_keys`` says that the keys are few (a bound the caller knows),
    and then no row of a hot key is shuffled. A null key or priority has no rows.
    """
    best = candidates.groupBy(F.col(key).alias("__key")).agg(F.min(priority).alias("__best"))  # combined before the shuffle
    return candidates.join(F.broadcast(best) if broadcast_keys else best, (F.col(key) == F.col("__key")) & (F.col(priority) == F.col("__best"))).drop("__key", "__best")


def resolve(symbols: DataFrame, wanted: Column) -> DataFrame:
    """Candidates per wanted name, with status: not_found can't occur here, ambiguous if more than one."""
    n = F.count("*").over(Window.partitionBy(wanted))
    return symbols.withColumn("status", F.when(n > 1, "ambiguous").otherwise("ok"))


def empty_if_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))
