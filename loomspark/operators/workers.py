"""Worker liveness: heartbeats, who is alive, which functions need a worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed moves of a worker's life.
TRANSITIONS = [("created", "starting"), ("starting", "running"), ("running", "deprecated"), ("running", "stopping"), ("deprecated", "stopping"), ("stopping", "stopped")]


def alive(workers: DataFrame, now: Column, debounce_seconds: Column | int) -> DataFrame:
    """Workers neither stopped nor deprecated whose last heartbeat is younger than the debounce."""
    seconds = debounce_seconds if isinstance(debounce_seconds, Column) else F.lit(debounce_seconds)
    limit = now - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return workers.filter(F.col("stopped_at").isNull() & F.col("deprecated_at").isNull() & (F.col("last_heartbeat_at") > limit))


def functions_to_start(functions: DataFrame, workers: DataFrame, now: Column, local: bool = False) -> DataFrame:
    """Enabled functions to wake: all of them locally, else those past their debounce without a live worker."""
    enabled = functions.filter("enabled")
    if local:
        return enabled.select("function_name")
    debounce = F.make_dt_interval(secs=F.col("debounce_seconds").cast("decimal(18,6)"))
    due = enabled.filter(F.col("last_invoked_at").isNull() | (F.col("last_invoked_at") < now - debounce))
    living = due.join(workers, "function_name").filter(
        F.col("stopped_at").isNull() & F.col("deprecated_at").isNull() & (F.col("last_heartbeat_at") > now - debounce)
    )
    return due.join(living.select("function_name").distinct(), "function_name", "left_anti").select("function_name")


def heartbeat_gaps(beats: DataFrame, key: str, at: str, limit_seconds: int) -> DataFrame:
    """Per key: number of gaps between beats longer than the limit, and the longest gap in seconds."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    micros = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    gaps = beats.select(key, F.floor(micros / 1000000).cast("long").alias("gap"))
    return gaps.groupBy(key).agg(F.count_if(F.col("gap") > limit_seconds).alias("n_gaps"), F.max("gap").alias("longest_gap"))


def track(functions: DataFrame, name: str, now: Column) -> DataFrame:
    """Upsert of a worker function: enabled and invoked now."""
    row = functions.sparkSession.range(1).select(F.lit(name).alias("function_name"), F.lit(True).alias("enabled"), F.lit(6).alias("debounce_seconds"), now.alias("last_invoked_at"))
    known = functions.withColumn("last_invoked_at", F.when(F.col("function_name") == name, now).otherwise(F.col("last_invoked_at")))
    return known.unionByName(row.join(functions, "function_name", "left_anti"))


def mark_stopped(workers: DataFrame, worker_id: str, now: Column) -> DataFrame:
    return workers.withColumn("stopped_at", F.when(F.col("worker_id") == worker_id, now).otherwise(F.col("stopped_at")))


def insert_worker(workers: DataFrame, worker_id: str, queue_name: str, function_name: str, now: Column) -> DataFrame:
    """``workers`` with one that starts and beats now; a known id is not inserted again."""
    row = workers.sparkSession.range(1).select(F.lit(worker_id).alias("worker_id"), F.lit(queue_name).alias("queue_name"), F.lit(function_name).alias("function_name"), now.alias("started_at"), now.alias("last_heartbeat_at"))
    new = row.join(workers.select("worker_id"), "worker_id", "left_anti")
    return workers.unionByName(new, allowMissingColumns=True)


def deprecate(workers: DataFrame, function_name: str, now: Column) -> DataFrame:
    """Living workers of a function are told to stop taking messages; those deprecated before keep their time."""
    mine = (F.col("function_name") == function_name) & F.col("deprecated_at").isNull() & F.col("stopped_at").isNull()
    return workers.withColumn("deprecated_at", F.when(mine, now).otherwise(F.col("deprecated_at")))


def beat(workers: DataFrame, beats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workers, answers): heartbeats (worker_id, at) move the last one; each answer says whether its worker is deprecated."""
    last = beats.groupBy("worker_id").agg(F.max("at").alias("__at"))
    joined = workers.join(last, "worker_id", "left")
    moved = joined.withColumn("last_heartbeat_at", F.greatest("last_heartbeat_at", F.col("__at"))).drop("__at")
    return moved, joined.filter("__at is not null").select("worker_id", F.col("deprecated_at").isNotNull().alias("is_deprecated"))


def invalid_transitions(log: DataFrame, key: str, state: str, at: list[str]) -> DataFrame:
    """Log rows whose move from the key's former state is not allowed."""
    moves = log.withColumn("__from", F.lag(state).over(Window.partitionBy(key).orderBy(*at))).filter("__from is not null")
    allowed = log.sparkSession.createDataFrame(TRANSITIONS, f"__from string, {state} string")
    return moves.join(F.broadcast(allowed), ["__from", state], "left_anti").withColumnRenamed("__from", "from_state")
