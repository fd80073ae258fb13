"""The test tables seen as workflow state: runs, tasks, dependencies and messages.

Each view exists twice, as a DataFrame and as SQL text for the oracle, with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges of the fixed example graph.
EDGES = [("root", "step_r"), ("root", "step_a"), ("step_r", "step_n"), ("step_a", "step_n"), ("step_n", "leaf1"), ("step_a", "leaf2")]

SQL = {
    "fx_runs": """SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 2 = 0 THEN 'flow_even' ELSE 'flow_odd' END AS flow_slug,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'started' ELSE 'failed' END AS status,
       o_orderpriority AS priority, o_orderdate AS started_at FROM orders""",
    "fx_tasks": """SELECT l_orderkey AS run_id,
       CASE l_returnflag WHEN 'R' THEN 'step_r' WHEN 'A' THEN 'step_a' ELSE 'step_n' END AS step_slug,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS INT) AS task_index,
       l_linenumber % 4 AS attempts_count,
       CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_linenumber % 2 = 0 THEN 'started' ELSE 'queued' END AS status,
       CAST(l_quantity AS INT) AS output, l_shipdate AS started_at FROM lineitem""",
    "fx_deps": "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EDGES) + ") AS t(dep_slug, step_slug)",
    "fx_msgs": """SELECT event_id AS msg_id, CASE event_type WHEN 'error' THEN 'q_err' ELSE 'q_ok' END AS queue_name,
       CAST(1 + event_id % 3 AS INT) AS read_ct, ts AS enqueued_at, props AS message, user_id FROM events""",
    "fx_arrays": "SELECT l_orderkey AS run_id, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS items FROM lineitem GROUP BY l_orderkey",
}


def with_views(body: str, *names: str) -> str:
    """Oracle SQL: the named views in front of ``body`` (which may start with its own CTEs)."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 2 == 0, "flow_even").otherwise("flow_odd").alias("flow_slug"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "started").otherwise("failed").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("started_at"),
    )


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = Window.partitionBy("l_orderkey", "l_returnflag").orderBy(*_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "step_r").when(F.col("l_returnflag") == "A", "step_a").otherwise("step_n").alias("step_slug"),
        (F.row_number().over(place) - 1).cast("int").alias("task_index"), (F.col("l_linenumber") % 4).alias("attempts_count"),
        F.when(F.col("l_linestatus") == "F", "completed").when(F.col("l_linenumber") % 2 == 0, "started").otherwise("queued").alias("status"),
        F.col("l_quantity").cast("int").alias("output"), F.col("l_shipdate").alias("started_at"),
    )


def deps(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame(EDGES, "dep_slug string, step_slug string")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.when(F.col("event_type") == "error", "q_err").otherwise("q_ok").alias("queue_name"),
        (1 + F.col("event_id") % 3).cast("int").alias("read_ct"), F.col("ts").alias("enqueued_at"), F.col("props").alias("message"), "user_id",
    )


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, items: each run's quantities in task order."""
    packed = F.array_sort(F.collect_list(F.struct(*_ORDER)))
    items = F.transform(packed, lambda x: x["l_quantity"].cast("bigint"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(items.alias("items"))


def run_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with its array; runs without tasks have an empty one."""
    empty = F.array().cast("array<bigint>")
    # Spark expects arrays of a few bytes, and would send millions of them through the driver.
    return runs(spark, sf_dir).select("run_id").join(arrays(spark, sf_dir).hint("merge"), "run_id", "left").withColumn("items", F.coalesce("items", empty))
