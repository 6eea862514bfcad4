"""Incoming callers to a depth, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.storage import stored


def incoming(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: every caller of ``roots`` (node) within ``depth`` levels, each once at its least depth.

    ``edges`` is (caller, callee). A level is a join, a distinct and an anti-join with what was
    visited; cycles end there. Roots aren't callers of themselves. The distinct edges and each level are stored once.
    """
    if depth < 1:
        raise ValueError("depth is 1 or more")
    edges = stored(edges.select("caller", "callee").where("caller != callee").distinct(), "call-edges")
    visited = stored(roots.select("node").distinct().withColumn("depth", F.lit(0)), "callers")
    frontier = visited
    for level in range(1, depth + 1):
        found = edges.join(frontier.select(F.col("node").alias("callee")), "callee").select(F.col("caller").alias("node")).distinct()
        frontier = stored(found.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "callers")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0")


def depth_first(edges: list[tuple[str, str]], root: str, depth: int) -> list[tuple[str, int]]:
    """The order of a depth-first walk that reserves all unseen callers of a node before it descends; for small closures."""
    callers: dict[str, list[str]] = {}
    for caller, callee in sorted(set(edges)):
        callers.setdefault(callee, []).append(caller)
    seen, out = {root}, []

    def descend(node: str, level: int) -> None:
        fresh = [c for c in callers.get(node, []) if c not in seen]
        seen.update(fresh)
        for c in fresh:
            out.append((c, level))
            if level < depth:
                descend(c, level + 1)

    if depth < 1:
        raise ValueError("depth is 1 or more")
    descend(root, 1)
    return out
