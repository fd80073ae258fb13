"""Event logs of runs and steps, and how a reader folds them into a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.scalars import json_text

#: Precedence of statuses; a terminal status is never left again.
RUN_RANK = {"started": 0, "completed": 1, "failed": 2}
STEP_RANK = {"created": 0, "started": 1, "completed": 2, "failed": 3, "skipped": 4}
RUN_TERMINAL = ("completed", "failed")
STEP_TERMINAL = ("completed", "failed", "skipped")


def event_name(status: Column, step: Column | None = None) -> Column:
    return F.concat(F.lit("run:"), status) if step is None else F.concat(F.lit("step:"), step, F.lit(":"), status)


def fold_status(events: DataFrame, keys: list[str], ranks: dict[str, int], terminal: tuple[str, ...], at: list[str]) -> DataFrame:
    """Status per key after all events in the order ``at``: the first terminal one, else the highest.

    Both parts are grouped minima and maxima, so they combine before the shuffle.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (k, v)]), F.col("status"))
    order = F.struct(*at)
    ended = F.min_by("status", F.when(F.col("status").isin(*terminal), order))
    return events.groupBy(*keys).agg(F.coalesce(ended, F.max_by("status", rank)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def event_order(events: DataFrame, keys: list[str], at: list[str]) -> DataFrame:
    """``seq``: each event's place in the log of its key, from 1."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*at)))


def snapshot(runs: DataFrame, states: DataFrame) -> DataFrame:
    """One row per run: its columns as JSON and its steps as an ordered JSON array (empty where none)."""
    steps = F.array_sort(F.collect_list(F.struct(*[c for c in states.columns if c != "run_id"])))
    grouped = states.groupBy("run_id").agg(F.to_json(steps).alias("steps"))
    return runs.select("run_id", F.to_json(F.struct(*runs.columns)).alias("run")).join(grouped, "run_id", "left").withColumn("steps", F.coalesce("steps", F.lit("[]")))


def parsed(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as VARIANT: JSON where the text is JSON, else the text itself as a string."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.try_parse_json(c), F.try_parse_json(json_text(F.col(c)))))
    return out


def valid_events(events: DataFrame) -> DataFrame:
    """Events whose type and status belong together: a run's or a step's known status, and a step's slug for steps."""
    parts = F.split("event_type", ":")
    side, said = parts[0], F.element_at(parts, -1)
    run = (side == "run") & F.col("status").isin(*RUN_RANK) & F.col("step_slug").isNull()
    step = (side == "step") & F.col("status").isin(*STEP_RANK) & F.col("step_slug").isNotNull()
    return events.filter(F.coalesce((run | step) & (said == F.col("status")), F.lit(False)))


def apply_events(snapshot: DataFrame, events: DataFrame, keys: list[str], ranks: dict[str, int], terminal: tuple[str, ...], at: str = "at") -> DataFrame:
    """A snapshot (keys, status, ``at``) brought up to date by the events after it.

    The snapshot counts as a key's first event, so one that is terminal stays, and
    events up to its moment add nothing; keys that only events know are added.
    """
    before = snapshot.select(*keys, "status", at, F.lit(0).alias("__later"))
    taken = snapshot.select(*keys, F.col(at).alias("__seen"))
    later = events.join(taken, keys, "left").filter(F.col("__seen").isNull() | (F.col(at) > F.col("__seen"))).select(*keys, "status", at, F.lit(1).alias("__later"))
    return fold_status(before.unionByName(later), keys, ranks, terminal, [at, "__later"]).drop("n_events")
