"""Settings of workers and of the schedules that keep them alive."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql.streaming import DataStreamWriter


@dataclass(frozen=True)
class QueueWorker:
    """Defaults of a worker on a plain queue; times in seconds, poll intervals in milliseconds."""

    max_concurrent: int = 10
    max_poll_seconds: int = 5
    poll_interval_ms: int = 200
    visibility_timeout: int = 10
    batch_size: int = 10
    retry_strategy: str = "exponential"
    retry_limit: int = 5
    retry_base_delay: int = 3
    retry_max_delay: int = 300


@dataclass(frozen=True)
class FlowWorker:
    """Defaults of a worker on a flow; retries are the steps' own."""

    max_concurrent: int = 10
    max_poll_seconds: int = 2
    poll_interval_ms: int = 100
    visibility_timeout: int = 5
    batch_size: int = 10


@dataclass(frozen=True)
class Schedule:
    """A named job that a stream's trigger repeats."""

    name: str
    every_seconds: int

    def trigger(self, writer: DataStreamWriter) -> DataStreamWriter:
        return writer.trigger(processingTime=f"{self.every_seconds} seconds")


def schedule(jobs: dict[str, Schedule], job: Schedule) -> dict[str, Schedule]:
    """``jobs`` with ``job``; one of the same name is replaced, so setting up twice is the same as once."""
    if job.every_seconds <= 0:
        raise ValueError("a schedule needs a positive interval")
    return {**jobs, job.name: job}


#: The two jobs that keep workers and tasks going.
ENSURE_WORKERS, REQUEUE_STALLED = Schedule("ensure_workers", 6), Schedule("requeue_stalled_tasks", 15)


def context(run_id: Any, step: str, task_index: int, attempt: int, config: FlowWorker | QueueWorker, flow_input: Any = None, env: dict[str, str] | None = None) -> dict:
    """What a handler gets beside its input."""
    return {"run_id": run_id, "step": step, "task_index": task_index, "attempt": attempt, "worker_config": config, "flow_input": flow_input, "env": dict(env or {})}
