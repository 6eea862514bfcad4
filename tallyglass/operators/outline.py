"""Outlines of classes: ranking members and cutting them to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.symbols import is_constructor

MAX_OUTLINE, MAX_EXPANDED, MAX_REMAINING = 12, 4, 6


def capped(members: DataFrame) -> DataFrame:
    """The first members of each owner, by line."""
    w = Window.partitionBy("owner").orderBy("line", "name")
    return members.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= MAX_OUTLINE).drop("__i")


def ranked(members: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Members (owner, name, line, end_line, visibility, perhaps kind) with rank_score and rank.

    Constructors by kind or name +5, public +3, bodies of 10 to 40 lines +2, a name with one of the request's words +2,
    lines in the first quarter of those from the first member's to the last's +1, single lines -1; equal scores keep the order of lines.
    """
    size = F.col("end_line") - F.col("line") + 1
    of = Window.partitionBy("owner")
    quarter = F.min("line").over(of) + F.floor((F.max("line").over(of) - F.min("line").over(of)) / 4)
    constructor = is_constructor(F.col("name"))
    if "kind" in members.columns:
        constructor = constructor | F.coalesce(F.col("kind") == "constructor", F.lit(False))
    named: Column = F.lit(False)
    for w in words or []:
        named = named | F.lower("name").contains(w.lower())
    out = members.withColumn("__q", quarter)
    score = (
        F.when(constructor, 5).otherwise(0) + F.when(F.col("visibility") == "public", 3).otherwise(0) + F.when(size.between(10, 40), 2).otherwise(0)
        + F.when(named, 2).otherwise(0) + F.when(F.col("line") <= F.col("__q"), 1).otherwise(0) - F.when(size <= 1, 1).otherwise(0)
    )
    out = out.withColumn("rank_score", score)
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("rank_score"), "line", "name"))
    return out.withColumn("rank", rank).drop("__q")


def expanded(ranked_members: DataFrame, budget: int) -> DataFrame:
    """The best members whose bodies fit one after another; the first that doesn't fit ends it."""
    size = F.col("end_line") - F.col("line") + 1
    used = F.sum(size).over(Window.partitionBy("owner").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked_members.withColumn("used_lines", used).where((F.col("used_lines") <= budget) & (F.col("rank") <= MAX_EXPANDED))


def remaining(ranked_members: DataFrame, shown: DataFrame) -> DataFrame:
    """The first members that aren't shown in full, by line."""
    left = ranked_members.join(shown.select("owner", "rank"), ["owner", "rank"], "left_anti")
    w = Window.partitionBy("owner").orderBy("line", "name")
    return left.withColumn("position", F.row_number().over(w)).where(F.col("position") <= MAX_REMAINING)


def reason(name: Column, visibility: Column) -> Column:
    """Why a member is shown."""
    parts = F.array_compact(F.array(F.when(is_constructor(name), F.lit("constructor")), F.when(visibility == "public", F.lit("public"))))
    return F.when(F.size(parts) == 0, F.lit("relevant")).otherwise(F.array_join(parts, ", "))
