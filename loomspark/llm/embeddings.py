"""Near-duplicate embeddings: an exact metric range join.

Vectors of a label are compared as points of the unit sphere, where a cosine of
c is a distance of sqrt(2 - 2c).  Pivots cut a label into cells; a point also
goes to every cell whose border is nearer than that distance, a bound that the
triangle inequality and the pivots' own distances give.  Inside a cell points lie
in rings around the pivot, as wide as that distance, so that a ring meets only
its neighbours.  Rings then join on their own, in blocks of bounded size, and each
block reports sums and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import discard, materialise
from loomspark.llm.components import connected_components

#: Pivots of a label: one for so many of its vectors.  Every point is measured against every pivot
#: of its label, so there are this many at most; more vectors make larger cells, which blocks cut.
PER_PIVOT, MAX_PIVOTS = 8192, 64
#: Vectors of a ring that one task compares with as many others, and how many at a time.
BLOCK, TILE = 8192, 1024
#: Slack on geometric bounds, against rounding; the cosine itself decides about a link.
SLACK = 1e-6


def usable(id_: Column, vector: Column, label: Column) -> Column:
    """Whether a vector can have links: id and label there, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = id_.isNotNull() & label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(found, F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square overflows or vanishes."""
    x = np.array(vectors.tolist(), float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(reach: float):
    """Cells of each point: its nearest pivot's, and each whose border is within reach; with the ring there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            out = []
            for _, group in rows.groupby(["label", "dim"], sort=False):
                points = _unit(group["v"])
                pivots = _unit(pd.Series(list(group["pivots"].iloc[0])))
                d2 = np.maximum(0, 2 - 2 * points @ pivots.T)
                home = d2.argmin(axis=1)
                own = d2[np.arange(len(points)), home]
                apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
                # Distance to the plane half way between the two pivots, and the plain triangle bound where they coincide.
                border = np.where(apart > 1e-9, (d2 - own[:, None]) / np.maximum(2 * apart, 1e-12), 0)
                within = border <= reach + SLACK
                within[np.arange(len(points)), home] = True
                who, cell = np.nonzero(within)
                part = group.iloc[who][["cls", "label", "dim", "weight", "v"]].copy()
                part["cell"], part["home"] = cell.astype(np.int32), cell == home[who]
                # A ring is wider than the reach by the slack: points within reach lie in the same or in adjacent rings.
                part["ring"] = np.floor(np.sqrt(d2[who, cell]) / (reach + SLACK)).astype(np.int32)
                out.append(part)
            yield pd.concat(out)

    return run


def _components(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each, given those found before (``at``) and more links."""
    while True:
        low = np.minimum(at[left], at[right])
        new = at.copy()
        # The links' ends and the components that they had so far all move.
        for ends in (left, right, at[left], at[right]):
            np.minimum.at(new, ends, low)
        new = new[new]
        if (new == at).all():
            return at
        at = new


def _join_block(least: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of links for home points of side 0, and forest edges, of one pair of blocks."""
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        empty = pd.DataFrame({"cls": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "to": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return empty
        ida, idb = a["cls"].to_numpy(), b["cls"].to_numpy()
        ids, place = np.unique(np.concatenate([ida, idb]), return_inverse=True)
        left, right, weight = _unit(a["v"]), _unit(b["v"]), b["weight"].to_numpy()
        counts, at = np.zeros(len(a), np.int64), np.arange(len(ids))
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                near = (left[i : i + TILE] @ right[j : j + TILE].T >= least) & (ida[i : i + TILE, None] != idb[None, j : j + TILE])
                x, y = np.nonzero(near)
                if len(x):
                    counts[i : i + TILE] += near @ weight[j : j + TILE]
                    at = _components(at, place[i + x], place[len(a) + j + y])
        low, hit = ids[at], counts > 0
        other = low != ids
        return pd.concat(
            [
                pd.DataFrame({"cls": ida[hit], "links": counts[hit], "to": ida[hit]}),
                pd.DataFrame({"cls": ids[other], "links": np.zeros(int(other.sum()), np.int64), "to": low[other]}),
            ]
        )

    return run


def link_embeddings(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` and ``kept`` (id equals component).

    Only vectors with equal labels and of equal length are compared.  Null, zero
    and non-finite vectors, vectors without label and those without id link with
    nothing: they are their own component and kept (without id, the component
    is null).  Every row is a vector of its own, also where ids repeat; its
    component is the smallest id that it reaches by links.  Equal vectors of a
    label are one class that is compared once; its members link with each other.
    Ids may be of any type with an order.  An empty table gives no rows, and no
    other column is read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("usable", usable(F.col("id"), F.col("v"), F.col("label")))
    good = rows.filter("usable").drop("usable").withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    # A class of equal vectors has a number of its own once it is written; sums combine before the shuffle.
    classes = good.groupBy("label", "key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = materialise(classes.withColumns({"dim": F.size("v"), "cls": F.monotonically_increasing_id()}), "vector-classes")
    reps = classes.select("cls", "label", "dim", "weight", "v")

    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.withColumn("wanted", F.least(F.lit(MAX_PIVOTS), F.greatest(F.lit(1), F.ceil(F.col("n") / PER_PIVOT))).cast("int"))
    # Drawn by hash with a bound, about twice as many as wanted; the least hash of a label is always in.
    hashed = reps.join(wanted, ["label", "dim"]).withColumn("h", F.pmod(F.xxhash64("v", F.lit("pivot")), F.lit(1 << 40)) / float(1 << 40))
    first = hashed.groupBy("label", "dim").agg(F.min_by("v", "h").alias("v"), F.min("h").alias("h"), F.first("wanted").alias("wanted"))
    drawn = hashed.filter(F.col("h") * F.col("n") < 2 * F.col("wanted") - 1).select("label", "dim", "v", "h", "wanted").unionByName(first)
    ordered = F.array_sort(F.collect_set(F.struct("h", "v")))
    pivots = drawn.groupBy("label", "dim").agg(F.transform(F.slice(ordered, F.lit(1), F.first("wanted")), lambda x: x["v"]).alias("pivots"))

    reach = math.sqrt(2 - 2 * cosine)
    label_kind = reps.schema["label"].dataType.simpleString()
    placed = reps.join(pivots, ["label", "dim"]).mapInPandas(_assign(reach), f"cls bigint, label {label_kind}, dim int, weight bigint, v array<double>, cell int, home boolean, ring int")
    placed = materialise(placed, "cells")
    # Home points of a ring on one side; on the other all points of that ring and of its neighbours.
    ring = ["label", "dim", "cell", "ring"]
    right = placed.withColumn("ring", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)))
    left = placed.filter("home")
    count = lambda side, name: side.groupBy(*ring).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = count(left, "m").join(count(right, "n"), ring)
    deal = lambda name: F.pmod(F.xxhash64("cls", F.lit("block")), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = left.join(blocks, ring).withColumns({"side": F.lit(0), "i": deal("m")}).withColumn("j", every("n"))
    right = right.join(blocks, ring).withColumns({"side": F.lit(1), "j": deal("n")}).withColumn("i", every("m"))
    columns = [*ring, "i", "j", "side", "cls", "weight", "v"]
    pairs = left.select(*columns).unionByName(right.select(*columns))
    found = materialise(pairs.groupBy(*ring, "i", "j").applyInPandas(_join_block(cosine), "cls bigint, links bigint, to bigint"), "vector-links")

    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("cls <> to"), "cls", "to").withColumnsRenamed({"node": "cls", "component": "part"})
    known = classes.select("label", "key", "cls", "low", "weight").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    lowest = known.groupBy("part").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "part").join(sums, "cls", "left").select("label", "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    known = materialise(known, "vector-components")
    discard(classes, placed, found)
    out = good.select("id", "label", "key").join(known, ["label", "key"]).select("id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    rest = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
