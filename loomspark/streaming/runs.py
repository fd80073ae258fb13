"""Keyed streaming execution of flows: a command stream in, an event stream out.

State is kept per run; commands are ``start`` (input), ``complete`` (step, task,
output), ``fail`` (step, task, error) and ``tick`` (a moment in seconds).  A tick
sets the run's clock: tasks whose backoff is over start again, and tasks that run
longer than timeout and grace are queued again, three times at most.  Without a
tick a run has no clock, and a failed task with attempts left starts again at once.

The state holds one row a step and one value a task; a map's outputs are gathered
in its step's row when its last task completes.  An ended run keeps its status alone.
While the commands of a run are applied, its cells are held as values, each read
from the store when first asked for and written once, if changed, after the last
command: a call to the store costs far more than a command.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from loomspark.operators.state import GRACE_SECONDS, MAX_REQUEUES
from loomspark.plans.containment import contains_value
from loomspark.plans.flow import Flow, Step
from loomspark.session import shared_folder

COMMANDS = "run_id string, seq bigint, command string, step_slug string, task_index int, payload string"
EVENTS = "run_id string, seq bigint, event_type string, step_slug string, task_index int, status string, payload string"


class Command(NamedTuple):
    """A row of COMMANDS but its run."""

    seq: int
    command: str
    step_slug: str | None
    task_index: float | None
    payload: str | None


class _Cells:
    """The cells of one map state while a run's commands are applied; ``stored`` tells whether the store may have any."""

    def __init__(self, state: Any, stored: bool) -> None:
        self.state, self.held, self.changed, self.stored, self.emptied = state, {}, set(), stored, False

    def get(self, key: str) -> dict | None:
        if key not in self.held:
            there = self.stored and self.state.containsKey((key,))
            self.held[key] = json.loads(self.state.getValue((key,))[0]) if there else None
        return self.held[key]

    def put(self, key: str, value: dict) -> None:
        self.held[key] = value
        self.changed.add(key)

    def items(self) -> list[tuple[str, dict]]:
        stored = {key[0]: json.loads(value[0]) for key, value in self.state.iterator() if key[0] not in self.held} if self.stored else {}
        self.held.update(stored)
        return sorted((k, v) for k, v in self.held.items() if v is not None)

    def clear(self) -> None:
        self.held, self.changed, self.stored, self.emptied = {}, set(), False, self.stored or self.emptied

    def save(self) -> None:
        if self.emptied:
            self.state.clear()
        for key in sorted(self.changed):
            self.state.updateValue((key,), (json.dumps(self.held[key]),))


class RunProcessor(StatefulProcessor):
    """Applies the commands of one run in order and emits its events."""

    def __init__(self, flow: Flow) -> None:
        self.flow = flow

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("v", StringType())])
        key = StructType([StructField("k", StringType())])
        self.run_state = handle.getValueState("run", text)
        self.step_state = handle.getMapState("steps", key, text)
        self.task_state = handle.getMapState("tasks", key, text)
        self.clock_state = handle.getValueState("clock", text)

    def close(self) -> None:
        pass

    def _load(self) -> None:
        value = lambda state: json.loads(state.get()[0]) if state.exists() else None
        self.run, self.run_changed = value(self.run_state), False
        # A run that is new, or that has ended, has nothing else in the store.
        live = self.run is not None and self.run["status"] == "started"
        self.clock, self.clock_changed = value(self.clock_state) if live else None, False
        self.steps, self.tasks = _Cells(self.step_state, live), _Cells(self.task_state, live)
        self.live_before, self.ended = live, self.run is not None and not live

    def _save(self) -> None:
        if self.run_changed:
            self.run_state.update((json.dumps(self.run),))
        if not self.live_before and (self.run is None or self.run["status"] != "started"):
            return  # nothing of it was ever in the store
        if self.clock_changed:
            self.clock_state.clear() if self.clock is None else self.clock_state.update((json.dumps(self.clock),))
        self.steps.save()
        self.tasks.save()

    # State cells hold small JSON values.
    def _step(self, slug: str) -> dict:
        return dict(self.steps.get(slug))

    def _put_step(self, slug: str, value: dict) -> None:
        self.steps.put(slug, value)

    def _task(self, slug: str, index: int) -> dict | None:
        return self.tasks.get(f"{slug}/{index}")

    def _put_task(self, slug: str, index: int, value: dict) -> None:
        self.tasks.put(f"{slug}/{index}", value)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        commands = [Command(*c) for part in rows for c in zip(*[part[f].tolist() for f in Command._fields], strict=True)]
        out: list[tuple] = []
        self._load()
        for c in sorted(commands, key=lambda c: c.seq):
            self.out, self.seq, self.run_id = out, int(c.seq), key[0]
            index = 0 if pd.isna(c.task_index) else int(c.task_index)
            if c.command == "start" and self.run is None:
                self._start(c.payload)
            elif c.command in ("complete", "fail"):
                self._report(c.command, c.step_slug, index, c.payload)
            elif c.command == "tick" and self.run is not None and self.run["status"] == "started":
                self._tick(float(json.loads(c.payload)))
            if self.run is not None and self.run["status"] != "started" and not self.ended:
                self._forget()
        self._save()
        yield pd.DataFrame(out, columns=["run_id", "seq", "event_type", "step_slug", "task_index", "status", "payload"])

    def _now(self) -> float | None:
        return self.clock

    def _forget(self) -> None:
        """An ended run keeps no steps and tasks: its status is enough to drop what comes late."""
        self._put_run({"status": self._run()["status"], "input": None})
        self.steps.clear()
        self.tasks.clear()
        self.clock, self.clock_changed, self.ended = None, True, True

    def _tick(self, moment: float) -> None:
        self.clock, self.clock_changed = moment, True
        for key, task in self.tasks.items():
            slug, _, index = key.rpartition("/")
            spec, index = self.flow.get(slug), int(index)
            if self._step(slug)["status"] != "started":
                continue
            late = task["status"] == "started" and task.get("since") is not None and moment > task["since"] + self.flow.option(spec, "timeout") + GRACE_SECONDS
            if task["status"] == "queued" and task["until"] <= moment:
                self._put_task(slug, index, {**task, "status": "started", "since": moment})
                self._emit("task:visible", "started", slug, {"attempt": task["attempts"]}, index)
            elif task["status"] == "started" and task.get("since") is None:
                self._put_task(slug, index, {**task, "since": moment})  # the first tick it sees starts its lease
            elif late and task.get("requeued", 0) < MAX_REQUEUES:
                self._put_task(slug, index, {**task, "since": moment, "requeued": task.get("requeued", 0) + 1})
                self._emit("task:requeued", "started", slug, {"requeued": task.get("requeued", 0) + 1}, index)
            elif late:
                self._put_task(slug, index, {**task, "status": "stalled"})
                self._emit("task:stalled", "stalled", slug, index=index)

    def _emit(self, kind: str, status: str, slug: str | None = None, payload: Any = None, index: int | None = None) -> None:
        self.out.append((self.run_id, self.seq, kind, slug, index, status, None if payload is None else json.dumps(payload)))

    def _run(self) -> dict:
        return self.run

    def _put_run(self, value: dict) -> None:
        self.run, self.run_changed = value, True

    def _start(self, payload: str) -> None:
        given = json.loads(payload)
        if any(s.kind == "map" and not s.depends_on for s in self.flow.steps) and not isinstance(given, list):
            self._emit("run:rejected", "rejected", payload="a root map needs an array")
            return
        self._put_run({"status": "started", "input": given})
        for s in self.flow.steps:
            self._put_step(s.slug, {"status": "created", "open": None})
        self._emit("run:started", "started", payload=given)
        self._advance()

    def _report(self, command: str, slug: str, index: int, payload: str) -> None:
        """A task's end; late ones and those of an ended run are only reported as dropped."""
        run = self.run
        step = self._step(slug) if run and self.steps.get(slug) is not None else None
        task = self._task(slug, index) if step else None
        if not run or run["status"] != "started" or not step or step["status"] != "started" or not task or task["status"] != "started":
            self._emit("task:dropped", "dropped", slug, index=index)
            return
        spec = self.flow.get(slug)
        if command == "fail":
            self._failed(spec, index, task, json.loads(payload) if payload else "error")
            return
        output = json.loads(payload) if payload is not None else None
        feeds = spec.kind == "single" and any(c.kind == "map" and slug in c.depends_on for c in self.flow.steps)
        if feeds and not isinstance(output, list):
            self._put_task(slug, index, {**task, "status": "failed", "output": output})
            self._fail_run(slug, "[TYPE_VIOLATION] a map step needs an array")
            return
        self._put_task(slug, index, {**task, "status": "completed", "output": output})
        step["open"] -= 1
        if step["open"] == 0:
            done = [self._task(slug, k)["output"] for k in range(step["tasks"])]
            step.update(status="completed", output=done if spec.kind == "map" else done[0])
            self._emit("step:completed", "completed", slug, step["output"])
        self._put_step(slug, step)
        self._advance()

    def _failed(self, spec: Step, index: int, task: dict, error: str) -> None:
        if task["attempts"] < self.flow.option(spec, "max_attempts"):
            delay = self.flow.option(spec, "base_delay") * 2 ** task["attempts"]
            now = self._now()
            wait = {} if now is None else {"status": "queued", "until": now + delay}
            self._put_task(spec.slug, index, {**task, **wait, "attempts": task["attempts"] + 1})
            self._emit("task:retry", "started", spec.slug, {"delay": delay, "attempt": task["attempts"] + 1}, index)
            return
        self._put_task(spec.slug, index, {**task, "status": "failed"})
        if spec.when_exhausted == "fail":
            self._fail_run(spec.slug, error)
            return
        self._skip(spec, "handler_failed", spec.when_exhausted == "skip-cascade")
        self._advance()

    def _fail_run(self, slug: str, error: str) -> None:
        self._put_step(slug, {**self._step(slug), "status": "failed", "error": error})
        self._emit("step:failed", "failed", slug, error)
        self._put_run({**self._run(), "status": "failed"})
        self._emit("run:failed", "failed", payload=error)

    def _skip(self, spec: Step, reason: str, cascade: bool) -> None:
        self._put_step(spec.slug, {"status": "skipped", "reason": reason, "open": None})
        self._emit("step:skipped", "skipped", spec.slug, reason)
        if cascade:
            for child in self.flow.steps:
                if spec.slug in child.depends_on and self._step(child.slug)["status"] in ("created", "started"):
                    self._skip(child, "dependency_skipped", True)

    def _advance(self) -> None:
        """Conditions, skips, empty maps and starts until nothing moves; then the run's end."""
        run, moved = self._run(), True
        while moved:
            moved, states = False, {s.slug: self._step(s.slug) for s in self.flow.steps}
            ready = [s for s in self.flow.steps if states[s.slug]["status"] == "created" and all(states[d]["status"] in ("completed", "skipped") for d in s.depends_on)]
            met = {}
            for s in ready:
                given = {d: states[d].get("output") for d in s.depends_on if states[d]["status"] == "completed"} if s.depends_on else run["input"]
                met[s.slug] = (s.if_ is None or contains_value(given, s.if_)) and (s.if_not is None or not contains_value(given, s.if_not))
            for s in ready:
                if not met[s.slug] and s.when_unmet == "fail":
                    self._fail_run(s.slug, "Condition not met")
                    return
            for s in ready:
                if self._step(s.slug)["status"] != "created":
                    continue
                moved = True
                if not met[s.slug]:
                    self._skip(s, "condition_unmet", s.when_unmet == "skip-cascade")
                    continue
                width = 1
                if s.kind == "map":
                    parent = states[s.depends_on[0]] if s.depends_on else None
                    width = len(run["input"] if parent is None else parent.get("output") or [] if parent["status"] == "completed" else [])
                if width == 0:
                    self._put_step(s.slug, {"status": "completed", "output": [], "open": 0, "tasks": 0})
                    self._emit("step:completed", "completed", s.slug, [])
                    continue
                self._put_step(s.slug, {"status": "started", "open": width, "tasks": width})
                for k in range(width):
                    self._put_task(s.slug, k, {"status": "started", "attempts": 1, "since": self._now()})
                self._emit("step:started", "started", s.slug, {"remaining_tasks": width})
        states = {s.slug: self._step(s.slug) for s in self.flow.steps}
        if all(s["status"] in ("completed", "skipped") for s in states.values()):
            leaves = {s.slug: states[s.slug].get("output") for s in self.flow.leaves() if states[s.slug]["status"] == "completed"}
            self._put_run({**run, "status": "completed"})
            self._emit("run:completed", "completed", payload=leaves or None)


def run_stream(flow: Flow, commands: DataFrame) -> DataFrame:
    """Events of a streaming (or static) frame of COMMANDS; needs the RocksDB state store provider."""
    plain = Flow(flow.slug, flow.options, tuple(Step(s.slug, None, s.kind, s.depends_on, s.if_, s.if_not, s.when_unmet, s.when_exhausted, s.options) for s in flow.steps))
    return commands.groupBy("run_id").transformWithStateInPandas(RunProcessor(plain), EVENTS, "Append", "None")


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def replay(flow: Flow, commands: DataFrame) -> DataFrame:
    """The events of a finished table of commands, by a stream that takes all of it and ends.

    Commands, checkpoint and events lie in the shared folder, so a lost executor
    costs a retry of its tasks.
    """
    spark = commands.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    commands.select(*[c.split()[0] for c in COMMANDS.split(", ")]).write.parquet(f"{folder}/commands")
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = run_stream(flow, spark.readStream.schema(COMMANDS).parquet(f"{folder}/commands"))
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/checkpoint")
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(EVENTS).parquet(f"{folder}/events")


def fold_stream(events: DataFrame) -> DataFrame:
    """Run status from an event stream, in update mode: the first terminal event wins, else the highest status."""
    from loomspark.operators.events import RUN_RANK, RUN_TERMINAL, fold_status

    runs = events.filter(F.startswith("event_type", F.lit("run:")) & F.col("status").isin(*RUN_RANK))
    return fold_status(runs, ["run_id"], RUN_RANK, RUN_TERMINAL, ["seq"])
