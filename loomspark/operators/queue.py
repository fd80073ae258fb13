"""Message queues as tables: send, visible reads, visibility changes, archive, delete.

A queue table has ``queue_name, msg_id, read_ct, enqueued_at, vt, message``; every
operator maps a snapshot to a new one, so each is a plain DataFrame plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import visible_at


MESSAGES = "queue_name string, msg_id bigint, read_ct int, enqueued_at timestamp, vt timestamp, message string"


def create_queue(queues: DataFrame, name: str, now: Column) -> DataFrame:
    """The table of queues (queue_name, created_at) with ``name``; one that is there already stays as it is."""
    row = queues.sparkSession.range(1).select(F.lit(name).alias("queue_name"), now.alias("created_at"))
    return queues.unionByName(row.join(queues.select("queue_name"), "queue_name", "left_anti"))


def drop_queue(queues: DataFrame, messages: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(queues, messages) without ``name`` and its messages; dropping an unknown queue changes nothing."""
    return queues.filter(F.col("queue_name") != name), messages.filter(F.col("queue_name") != name)


def send_batch(queue: DataFrame, messages: DataFrame, now: Column, delay: Column | int = 0) -> DataFrame:
    """``queue`` with ``messages`` (queue_name, msg_id, message) appended, visible after ``delay`` seconds."""
    delay = delay if isinstance(delay, Column) else F.lit(delay)
    rows = messages.select("queue_name", "msg_id", F.lit(0).alias("read_ct"), now.alias("enqueued_at"), visible_at(now, delay).alias("vt"), "message")
    return queue.unionByName(rows)


def read_visible(queue: DataFrame, now: Column, quantity: int, visibility: int, keys: list[str] | None = None) -> DataFrame:
    """The first ``quantity`` visible messages of each queue, with raised count and moved visibility.

    A rank that is compared with a constant becomes a group limit in the plan
    (``WindowGroupLimit``, partial before the exchange), so a queue of any size
    sends at most ``quantity`` rows of each partition.
    """
    keys = keys or ["queue_name"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("msg_id"))
    first = queue.filter(F.col("vt") <= now).withColumn("__place", place).filter(F.col("__place") <= quantity).drop("__place")
    return first.withColumn("read_ct", F.col("read_ct") + 1).withColumn("vt", visible_at(now, F.lit(visibility)))


def set_visibility(queue: DataFrame, ids: list[int], offsets: list[int], now: Column) -> DataFrame:
    """Messages of ``ids`` with visibility ``now`` plus the paired offset; unknown ids are ignored."""
    if len(ids) != len(offsets):
        raise ValueError("ids and offsets differ in length")
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, ids)).alias("msg_id"), F.array(*map(F.lit, offsets)).alias("offset")))
    wanted = queue.sparkSession.range(1).select(pairs.alias("p")).select(F.col("p.msg_id").cast("long").alias("msg_id"), F.col("p.offset").alias("offset")) if ids else None
    if wanted is None:
        return queue.limit(0)
    return queue.join(wanted, "msg_id").withColumn("vt", visible_at(now, F.col("offset"))).drop("offset")


def archive(queue: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(remaining queue, archived rows with ``archived_at``) for the messages in ``ids``."""
    return queue.join(ids, "msg_id", "left_anti"), queue.join(ids, "msg_id", "left_semi").withColumn("archived_at", now)


def delete(queue: DataFrame, ids: DataFrame) -> DataFrame:
    return queue.join(ids, "msg_id", "left_anti")


def match_tasks(messages: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two-phase poll: (messages with their queued task, messages without one)."""
    queued = tasks.filter(F.col("status") == "queued")
    return messages.join(queued.drop("status"), "msg_id"), messages.join(queued.select("msg_id"), "msg_id", "left_anti")


def settle(messages: DataFrame, failed: Column, limit: int, base: int, cap: int = 300) -> DataFrame:
    """Fate of handled messages: archived, or delivered again after a growing delay."""
    from loomspark.functions.scalars import message_retry_delay

    again = failed & (F.col("read_ct") < limit + 1)
    return messages.withColumn("outcome", F.when(again, "retry").when(failed, "archived_failed").otherwise("archived")).withColumn(
        "delay", F.when(again, message_retry_delay(F.lit(base), F.col("read_ct"), cap)).otherwise(0)
    )
