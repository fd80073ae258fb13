"""Operators on step graphs given as edge tables (dep_slug, step_slug)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import written


def nodes(deps: DataFrame) -> DataFrame:
    return deps.select(F.col("dep_slug").alias("step_slug")).union(deps.select("step_slug")).distinct()


def leaves(deps: DataFrame) -> DataFrame:
    """Steps that no step depends on."""
    return nodes(deps).join(deps.select(F.col("dep_slug").alias("step_slug")), "step_slug", "left_anti")


def descendants(deps: DataFrame) -> DataFrame:
    """(ancestor, step_slug, depth): transitive closure with the shortest depth.

    Edge tables are definitions, a few rows a flow, so each level is a small
    join; the loop ends with the first level that adds nothing.  A walk longer
    than there are steps is a cycle, which is an error.
    """
    step = deps.select(F.col("dep_slug").alias("at"), F.col("step_slug").alias("next"))
    frontier = written(deps.select(F.col("dep_slug").alias("ancestor"), "step_slug", F.lit(1).alias("depth")).distinct(), "closure")
    found, level, steps = frontier, 1, nodes(deps).count()
    while True:
        level += 1
        after = frontier.join(step, frontier["step_slug"] == step["at"]).select("ancestor", F.col("next").alias("step_slug"), F.lit(level).alias("depth")).distinct()
        frontier = written(after, "closure")
        if frontier.isEmpty():
            return found.groupBy("ancestor", "step_slug").agg(F.min("depth").alias("depth"))
        if level > steps:
            raise ValueError("the steps' dependencies form a cycle")
        found = found.unionByName(frontier)


def waves(deps: DataFrame) -> DataFrame:
    """(step_slug, wave): longest path from a root; roots are wave 0."""
    edges, depth = [(r[0], r[1]) for r in deps.select("dep_slug", "step_slug").collect()], {}
    for a, b in edges:
        depth.setdefault(a, 0), depth.setdefault(b, 0)
    for _ in range(len(depth) + 1):
        moved = False
        for a, b in edges:
            if depth[b] < depth[a] + 1:
                depth[b], moved = depth[a] + 1, True
        if not moved:
            break
    else:
        raise ValueError("the steps' dependencies form a cycle")
    return deps.sparkSession.createDataFrame(sorted(depth.items()), "step_slug string, wave int")
