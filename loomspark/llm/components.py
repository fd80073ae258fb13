"""Connected components of a graph given as edges, by repeated contraction.

Each round, every node joins its neighbour (or itself) with the smallest random
rank, edges move to the joined nodes and shrink; the ranks are new in every
round, so a path contracts as fast as a star.  All steps are joins and grouped
minima with partial aggregation; a hub's edges are never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with an edge; ``component`` is the smallest node reachable.

    Edges are undirected; null ends, loops and repeats do no harm.  Nodes
    without an edge to another are not listed.
    """
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    live = materialise(live.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    steps: list[DataFrame] = []
    rounds = 0
    while not live.isEmpty():
        rounds += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), c.alias("n"))  # noqa: B023, E731
        both = live.select("u", "v").union(live.select("v", "u"))
        step = both.groupBy("u").agg(F.min(rank(F.col("v"))).alias("best")).select("u", F.least(rank(F.col("u")), F.col("best"))["n"].alias("to"))
        step = materialise(step, "joined")
        steps.append(step)
        ends = step.select(F.col("u").alias("n"), F.col("to").alias("m"))
        moved = live.join(ends.withColumnsRenamed({"n": "u", "m": "mu"}), "u").join(ends.withColumnsRenamed({"n": "v", "m": "mv"}), "v")
        moved = moved.filter("mu <> mv").select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v"))
        before, live = live, materialise(moved.distinct(), "edges")
        discard(before)
    if not steps:
        return materialise(live.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
    placed = steps[0].select(F.col("u").alias("node"), F.col("to").alias("at"))
    for step in steps[1:]:
        placed = placed.join(step.withColumnRenamed("u", "at"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    smallest = placed.groupBy("at").agg(F.min("node").alias("component"))
    found = materialise(placed.join(smallest, "at").select("node", "component"), "components")
    discard(live, *steps)
    return found
