"""Sources that start runs: inserted rows, changed rows, scheduled selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.state import Snapshot, start_runs
from loomspark.plans.flow import Flow


def start_for_rows(flow: Flow, rows: DataFrame, run_id: Column, payload: Column, now: Column) -> Snapshot:
    """Start a run for each row, with the payload (a struct) as its JSON input."""
    snap, _ = start_runs(flow, rows.select(run_id.cast("string").alias("run_id"), F.to_json(payload).alias("input")), now)
    return snap


def changed_rows(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose column differs between two snapshots, with both values (nulls compare equal)."""
    a = old.select(key, F.col(column).alias(f"old_{column}"))
    b = new.select(key, F.col(column).alias(f"new_{column}"))
    return a.join(b, key).filter(~F.col(f"old_{column}").eqNullSafe(F.col(f"new_{column}")))
