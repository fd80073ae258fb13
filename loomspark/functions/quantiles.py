"""Exact quantiles of a column of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import written


def exact_quantiles(df: DataFrame, column: str, points: list[float], names: list[str]) -> DataFrame:
    """One row with the interpolated quantiles of ``column``; nulls do not count, without values all are null.

    Values are counted first, so ties of any number are one row; the counts are
    sorted by ranges, and the running totals of the ranges (one row a partition)
    say where each rank lies.  No task holds more than its range.
    """
    value = F.col(column).cast("double")
    counted = df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranged = written(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "quantiles")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", F.sum("total").over(Window.orderBy("part")).alias("upto"), "total", F.sum("total").over(Window.partitionBy()).alias("all"))
    before = before.select("part", (F.col("upto") - F.col("total")).alias("base"), "all")
    placed = ranged.join(F.broadcast(before), "part").withColumn("last", F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))
    cuts, out = [], []
    for k, p in enumerate(points):
        place = F.lit(p) * (F.col("all") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            cuts.append(F.min(F.when(F.col("last") > rank, F.col("v"))).alias(f"{side}{k}"))
        share = F.lit(p) * (F.col("all") - 1) - F.floor(F.lit(p) * (F.col("all") - 1))
        out.append((F.col(f"low{k}") + share * (F.col(f"high{k}") - F.col(f"low{k}"))).alias(names[k]))
    return placed.agg(F.max("all").alias("all"), *cuts).select(*out)
