"""Orchestration over snapshots: whole tables of runs, step states and tasks in, new tables out.

Each operator applies a batch of starts, completions or failures of any number of
runs.  Payloads are JSON text.  A flow's definition is small and known when the
plan is built, so a run is folded as one row: its step states are columns, its tasks
an array beside its input and outputs, which are arrays in one value as well.
Conditions, skips, empty maps and starts are decided wave by wave as projections.
A call joins these rows with its reports once, by run, whatever the depth of the
graph, and ends by writing them to the shared folder, so plans do not grow over calls.
The join has as many partitions as the rows' size in memory asks for, since their
shuffled bytes, by which Spark would merge partitions, are a small part of it.
The tables of a snapshot are views of its rows.

``Snapshot.events`` are those of the last call.  A task's row also stands for its
message: ``visible_at`` is when it may be read, ``archived_at`` when it left the queue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from loomspark.functions.scalars import json_kind, retry_delay, visible_at
from loomspark.plans.containment import condition_met
from loomspark.plans.flow import Flow, Step
from loomspark.session import written

GRACE_SECONDS, MAX_REQUEUES, LEASE_SECONDS = 30, 3, 2
RUNS = "run_id string, status string, input string, output string, remaining_steps int, started_at timestamp, ended_at timestamp"
STATES = "run_id string, step_slug string, status string, initial_tasks int, remaining_tasks int, remaining_deps int, output string, error string, skip_reason string, started_at timestamp, ended_at timestamp"
TASKS = (
    "run_id string, step_slug string, task_index int, status string, attempts_count int, output string, error string, visible_at timestamp, "
    "worker string, started_at timestamp, ended_at timestamp, requeued_count int, permanently_stalled_at timestamp, archived_at timestamp"
)
EVENTS = "run_id string, seq int, event_type string, step_slug string, status string, payload string, at timestamp"
KEYS = ["run_id", "step_slug", "task_index"]
#: The columns that a step has in a run's row, each followed by the step's number.
_FIELDS = {"was": "string", "status": "string", "initial_tasks": "int", "remaining_tasks": "int", "output": "string", "error": "string", "skip_reason": "string", "started_at": "timestamp", "ended_at": "timestamp"}
_DONE = ("completed", "skipped")
#: The fields of a task in a run's row: the step's number, those of TASKS but the keys, and whether the last call moved it.
_TASK = {"place": "int", "task_index": "int", **dict(c.split() for c in TASKS.split(", ")[3:]), "moved": "boolean"}
#: Bytes in memory, about: of a column of a run's row and of a task with its report, beside their texts; and of a partition of a join.
_COLUMN_BYTES, _TASK_BYTES, _PART_BYTES = 12, 256, 256 << 20
_ARRAY = "array<struct<" + ", ".join(f"{f}: {kind}" for f, kind in _TASK.items()) + ">>"


@dataclass(frozen=True)
class Snapshot:
    flow: Flow
    runs: DataFrame
    states: DataFrame
    tasks: DataFrame
    events: DataFrame | None = None
    #: (rows, runs, states, tasks) of the call that made the snapshot: the rows hold as long as its tables are these views.
    made: tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None = None


def stalled(tasks: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """Started tasks past timeout and grace that are not given up yet, with the ``outcome`` they get."""
    limit = now - F.make_dt_interval(secs=(timeout + GRACE_SECONDS).cast("decimal(18,6)"))
    found = tasks.filter((F.col("status") == "started") & F.col("permanently_stalled_at").isNull() & (F.col("started_at") < limit))
    return found.withColumn("outcome", F.when(F.col("requeued_count") < MAX_REQUEUES, "queued").otherwise("permanently_stalled"))


def requeue_stalled(tasks: DataFrame, now: Column, timeout: Column) -> DataFrame:
    """All tasks, with stalled ones queued again (attempts untouched, visible at once) or given up and archived.

    The columns ``worker``, ``visible_at`` and ``archived_at`` follow where ``tasks`` has them.
    """
    limit = now - F.make_dt_interval(secs=(timeout + GRACE_SECONDS).cast("decimal(18,6)"))
    hit = (F.col("status") == "started") & F.col("permanently_stalled_at").isNull() & (F.col("started_at") < limit)
    again = hit & (F.col("requeued_count") < MAX_REQUEUES)
    change = {
        "status": F.when(again, "queued").otherwise(F.col("status")),
        "started_at": F.when(~again, F.col("started_at")),
        "requeued_count": F.col("requeued_count") + again.cast("int"),
        "permanently_stalled_at": F.when(hit & ~again, now).otherwise(F.col("permanently_stalled_at")),
    }
    if "worker" in tasks.columns:
        change["worker"] = F.when(~again, F.col("worker"))
    if "visible_at" in tasks.columns:
        change["visible_at"] = F.when(again, now).otherwise(F.col("visible_at"))
    if "archived_at" in tasks.columns:
        change["archived_at"] = F.when(hit & ~again, now).otherwise(F.col("archived_at"))
    return tasks.withColumns(change)


def requeue(snap: Snapshot, now: Column) -> Snapshot:
    """The snapshot with its stalled tasks queued again or given up; the timeout is the flow's."""
    timeout = F.lit(snap.flow.options.get("timeout", 60))
    return Snapshot(snap.flow, snap.runs, snap.states, requeue_stalled(snap.tasks, now, timeout), snap.runs.sparkSession.createDataFrame([], EVENTS))


def messages(snap: Snapshot) -> DataFrame:
    """The queue of the snapshot's open tasks: queue_name, msg_id, read_ct, vt, message (JSON)."""
    body = F.to_json(F.struct(F.lit(snap.flow.slug).alias("flow_slug"), *KEYS))
    return snap.tasks.filter("archived_at is null").select(
        F.lit(snap.flow.slug).alias("queue_name"), F.concat_ws("/", *KEYS).alias("msg_id"), F.col("attempts_count").alias("read_ct"), F.col("visible_at").alias("vt"), body.alias("message")
    )


def _by_step(flow: Flow, value) -> Column:
    """A constant per step, chosen by ``step_slug``."""
    pairs = [x for s in flow.steps for x in (F.lit(s.slug), F.lit(value(s)))]
    return F.element_at(F.create_map(*pairs), F.col("step_slug"))


def _at(flow: Flow, value, place: Column) -> Column:
    """A constant (or a column that is the same for all tasks) per step, chosen by the step's number."""
    return F.get(F.array(*[F.lit(value(s)) for s in flow.steps]), place)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _task(fields: dict[str, Column], old: Column | None = None) -> Column:
    """A task of ``_TASK``; fields that are not given are those of ``old``, or null."""
    rest = lambda f: F.lit(None) if old is None else old[f]
    return F.struct(*[(fields[f] if f in fields else rest(f)).cast(kind).alias(f) for f, kind in _TASK.items()])


def _of_step(k: int):
    return lambda t: t["place"] == k


def _statuses(flow: Flow) -> Column:
    return F.array(*[F.col(f"status{k}") for k in range(len(flow.steps))])


def _object(pairs: list[tuple[str, Column, Column]]) -> Column:
    """JSON object of (key, JSON text, present); a missing value is null."""
    parts = [F.when(present, F.concat(F.lit(f'"{key}":'), F.coalesce(text, F.lit("null")))) for key, text, present in pairs]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _parents(flow: Flow, s: Step) -> list[int]:
    place = {x.slug: k for k, x in enumerate(flow.steps)}
    return [place[d] for d in s.depends_on]


def _cascades(flow: Flow, k: int) -> Column:
    """Whether the skip of step ``k`` takes its descendants along."""
    s, why = flow.steps[k], F.col(f"skip_reason{k}")
    out = why == "dependency_skipped"
    if s.when_unmet == "skip-cascade":
        out = out | (why == "condition_unmet")
    if s.when_exhausted == "skip-cascade":
        out = out | (why == "handler_failed")
    return F.coalesce(out, F.lit(False))


def _fold(flow: Flow, wide: DataFrame, now: Column) -> DataFrame:
    """Rows of runs after conditions, skips, empty maps and starts, as far as they reach, and the run's end.

    In a wave all conditions are decided first: the first that fails the run (by
    step index) stops everything after it, and no step starts in that call.
    """
    place = {s.slug: k for k, s in enumerate(flow.steps)}
    df = wide.withColumn("__open", F.col("status") == "started")
    for wave in flow.waves():
        gates, unmet = {}, {}
        for s in wave:
            k, parents = place[s.slug], _parents(flow, s)
            resolved, cascaded = F.lit(True), F.lit(False)
            for p in parents:
                resolved, cascaded = resolved & F.col(f"status{p}").isin(*_DONE), cascaded | _cascades(flow, p)
            created = F.col("__open") & (F.col(f"status{k}") == "created")
            gates[f"__cascaded{k}"], gates[f"__ready{k}"] = created & cascaded, created & ~cascaded & resolved
            if s.if_ is not None or s.if_not is not None:
                given = _object([(flow.steps[p].slug, F.col(f"output{p}"), F.col(f"status{p}") == "completed") for p in parents]) if parents else F.col("input")
                unmet[k] = ~condition_met(F.parse_json(given), VariantType(), s.if_, s.if_not)
        df = df.withColumns(gates)
        if unmet:
            df = df.withColumns({f"__unmet{k}": F.col(f"__ready{k}") & x for k, x in unmet.items()})
        blocked = F.lit(None).cast("int")
        for k in sorted(unmet, reverse=True):
            if flow.steps[k].when_unmet == "fail":
                blocked = F.when(F.col(f"__unmet{k}"), k).otherwise(blocked)
        df = df.withColumn("__blocked", blocked)
        new = {"__open": F.col("__open") & F.col("__blocked").isNull()}
        for s in wave:
            k, parents = place[s.slug], _parents(flow, s)
            fails, fine = F.col("__blocked") == k, F.col("__blocked").isNull()
            skip = fine & F.col(f"__unmet{k}") if k in unmet else F.lit(False)
            cascaded, go = fine & F.col(f"__cascaded{k}"), fine & F.col(f"__ready{k}") & ~skip
            tasks = F.col(f"initial_tasks{k}")
            if s.kind == "map" and parents:
                tasks = F.when(F.col(f"status{parents[0]}") == "completed", F.coalesce(F.json_array_length(f"output{parents[0]}"), F.lit(0))).otherwise(0)
            empty = go & (tasks == 0)
            new |= {
                f"status{k}": F.when(fails, "failed").when(cascaded | skip, "skipped").when(empty, "completed").when(go, "ready").otherwise(F.col(f"status{k}")),
                f"initial_tasks{k}": F.when(go, tasks).otherwise(F.col(f"initial_tasks{k}")),
                f"remaining_tasks{k}": F.when(go, tasks).otherwise(F.col(f"remaining_tasks{k}")),
                f"output{k}": F.when(empty, "[]").otherwise(F.col(f"output{k}")),
                f"error{k}": F.when(fails, "Condition not met").otherwise(F.col(f"error{k}")),
                f"skip_reason{k}": F.when(cascaded, "dependency_skipped").when(skip, "condition_unmet").otherwise(F.col(f"skip_reason{k}")),
                f"started_at{k}": F.when(go, now).otherwise(F.col(f"started_at{k}")),
                f"ended_at{k}": F.when(fails | cascaded | skip | empty, now).otherwise(F.col(f"ended_at{k}")),
            }
        df = df.withColumns(new).drop("__blocked", *gates, *[f"__unmet{k}" for k in unmet])
    steps = range(len(flow.steps))
    left = F.lit(0)
    for k in steps:
        left = left + (~F.col(f"status{k}").isin(*_DONE)).cast("int")
    waits = {f"status{k}": F.when(F.col(f"status{k}") != "ready", F.col(f"status{k}")).when(F.col("__open"), "started").otherwise("created") for k in steps}
    begun = {f"started_at{k}": F.when((F.col(f"status{k}") != "ready") | F.col("__open"), F.col(f"started_at{k}")) for k in steps}
    df = df.withColumns({**begun, "remaining_steps": left})
    df = df.withColumns(waits)
    done = F.col("__open") & (F.col("remaining_steps") == 0)
    leaves = sorted(flow.leaves(), key=lambda s: s.slug)
    some = F.lit(False)
    for s in leaves:
        some = some | (F.col(f"status{place[s.slug]}") == "completed")
    output = F.when(some, _object([(s.slug, F.col(f"output{place[s.slug]}"), F.col(f"status{place[s.slug]}") == "completed") for s in leaves]))
    ends = done | ~F.col("__open") & (F.col("status") == "started")
    return df.withColumns(
        {
            "output": F.when(done, output).otherwise(F.col("output")), "ended_at": F.when(ends, now).otherwise(F.col("ended_at")), "__ends": ends,
            "status": F.when(done, "completed").when(ends, "failed").otherwise(F.col("status")),
        }
    ).drop("__open")


def _kept(snap: Snapshot) -> bool:
    """Whether the rows of the call that made the snapshot still hold."""
    return snap.made is not None and all(x is y for x, y in zip(snap.made[1:], (snap.runs, snap.states, snap.tasks), strict=True))


def _row_bytes(flow: Flow) -> Column:
    """The size of a run's row in memory with a report for each task, about."""
    texts = ["input", "output", *[f"{f}{k}" for k in range(len(flow.steps)) for f in ("output", "error")]]
    lengths = [F.coalesce(F.length(x), F.lit(0)) for x in (*texts, F.array_join("tasks.output", ""))]
    fixed = _COLUMN_BYTES * (len(RUNS.split(", ")) + len(_FIELDS) * len(flow.steps))
    return sum(lengths, F.lit(fixed) + _TASK_BYTES * F.size("tasks.place")).cast("long")


def _partitions(*sized: tuple[DataFrame, Column]) -> int:
    """How many partitions of ``_PART_BYTES`` hold the tables, each given with the size of a row; as many as there are cores at least."""
    total = sum(df.agg(F.sum(size)).first()[0] or 0 for df, size in sized)
    return max(sized[0][0].sparkSession.sparkContext.defaultParallelism, -(-total // _PART_BYTES))


def _rows(snap: Snapshot) -> DataFrame:
    """One row a run: its columns, those of ``_FIELDS`` of each step, and its tasks.

    A snapshot that a call made has its rows already.  Any other is put together
    from its tables, where each state and task belongs to a run and a step.
    """
    flow = snap.flow
    if _kept(snap):
        return snap.made[0].drop("__new", "__ends")
    fields = [f for f in _FIELDS if f != "was"]
    entries = F.map_from_entries(F.collect_list(F.struct("step_slug", F.struct(F.col("status").alias("was"), *fields))))
    length = lambda *texts: sum((F.coalesce(F.length(x), F.lit(0)) for x in texts), F.lit(0))
    parts = _partitions(
        (snap.runs, (length("input", "output") + _COLUMN_BYTES * len(snap.runs.columns)).cast("long")),
        (snap.states, (length("output", "error") + _COLUMN_BYTES * len(_FIELDS)).cast("long")),
        (snap.tasks, (length("output", "error") + _TASK_BYTES).cast("long")),
    )
    runs, states, tasks = (df.repartition(parts, "run_id") for df in (snap.runs, snap.states, snap.tasks))
    states = states.groupBy("run_id").agg(entries.alias("__states"))
    columns = {"place": _by_step(flow, flow.steps.index), "moved": F.lit(False)}
    tasks = tasks.groupBy("run_id").agg(F.collect_list(F.struct(*[(columns[f] if f in columns else F.col(f)).cast(kind).alias(f) for f, kind in _TASK.items()])).alias("tasks"))
    steps = [F.col("__states")[s.slug][f].alias(f"{f}{k}") for k, s in enumerate(flow.steps) for f in _FIELDS]
    joined = runs.join(states.hint("merge"), "run_id", "left").join(tasks.hint("merge"), "run_id", "left")
    return joined.select(*snap.runs.columns, *steps, F.coalesce("tasks", F.array().cast(_ARRAY)).alias("tasks"))


def _narrow(flow: Flow, wide: DataFrame) -> DataFrame:
    """The step states of the runs' rows, with ``__run``, the status of their run."""
    rows = []
    for k, s in enumerate(flow.steps):
        open_ = sum(((~F.col(f"status{p}").isin(*_DONE)).cast("int") for p in _parents(flow, s)), F.lit(0))
        rest = [F.col(f"{f}{k}").alias(f) for f in _FIELDS if f not in ("was", "status", "initial_tasks", "remaining_tasks")]
        rows.append(F.struct(F.lit(s.slug).alias("step_slug"), F.col(f"status{k}").alias("status"), F.col(f"initial_tasks{k}").alias("initial_tasks"), F.col(f"remaining_tasks{k}").alias("remaining_tasks"), open_.alias("remaining_deps"), *rest))
    return wide.select("run_id", F.col("status").alias("__run"), F.explode(F.array(*rows)).alias("s")).select("run_id", "__run", "s.*")


def states_of_runs(snap: Snapshot) -> DataFrame:
    """The step states with ``run_status``, the status of their run, which lies in the same row."""
    return _narrow(snap.flow, _rows(snap)).withColumnRenamed("__run", "run_status")


def messages_by_step(snap: Snapshot) -> DataFrame:
    """How many messages of each run's steps are ``in_queue``, for steps with tasks: counted in the run's row, without a shuffle."""

    def count(slug: str):
        return lambda left: F.when(F.size(left) > 0, F.struct(F.lit(slug).alias("step_slug"), F.size(F.filter(left, lambda x: x)).cast("long").alias("in_queue")))

    counts = [_let(F.transform(F.filter("tasks", _of_step(k)), lambda t: t["archived_at"].isNull()), count(s.slug)) for k, s in enumerate(snap.flow.steps)]
    return _rows(snap).select("run_id", F.explode(F.filter(F.array(*counts), lambda x: x.isNotNull())).alias("c")).select("run_id", "c.*")


def _events(flow: Flow, wide: DataFrame, now: Column) -> DataFrame:
    """The events of a call, by comparing each step with what it was before."""
    wave = {s.slug: w for w, steps in enumerate(flow.waves()) for s in steps}
    shared = [F.col("run_id"), F.lit(flow.slug).alias("flow_slug")]

    def event(seq: int, kind: Column, slug: str | None, status: Column, payload: list[Column], when: Column) -> Column:
        body = F.to_json(F.struct(*shared, status.alias("status"), *payload))
        return F.when(when, F.struct(F.lit(seq).alias("seq"), kind.alias("event_type"), F.lit(slug).cast("string").alias("step_slug"), status.alias("status"), body.alias("payload")))

    rows = [event(0, F.lit("run:started"), None, F.lit("started"), [F.col("input"), F.col("remaining_steps")], F.col("__new"))]
    for k, s in enumerate(flow.steps):
        status = F.col(f"status{k}")
        moved = ~status.eqNullSafe(F.col(f"was{k}")) & (status != "created")
        detail = [F.lit(s.slug).alias("step_slug"), *[F.col(f"{f}{k}").alias(f) for f in ("output", "error", "skip_reason", "remaining_tasks", "started_at", "ended_at")]]
        rows.append(event(1 + wave[s.slug] * len(flow.steps) + k, F.concat(F.lit("step:"), status), s.slug, status, detail, moved))
    last = 1 + len(flow.steps) * (1 + max(wave.values(), default=0))
    rows.append(event(last, F.concat(F.lit("run:"), F.col("status")), None, F.col("status"), [F.col("output"), F.col("ended_at")], F.col("__ends")))
    found = wide.select("run_id", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select("run_id", "e.*")
    return found.withColumn("at", now)


def _views(flow: Flow, wide: DataFrame, events: DataFrame) -> Snapshot:
    """The snapshot of rows in the shared folder."""
    runs, states = wide.select(*[c.split()[0] for c in RUNS.split(", ")]), _narrow(flow, wide).drop("__run")
    slug = _at(flow, lambda s: s.slug, F.col("t.place"))
    tasks = wide.select("run_id", F.explode("tasks").alias("t")).select("run_id", slug.alias("step_slug"), *[f"t.{c.split()[0]}" for c in TASKS.split(", ")[2:]])
    return Snapshot(flow, runs, states, tasks, events, (wide, runs, states, tasks))


def _finish(flow: Flow, wide: DataFrame, now: Column) -> Snapshot:
    """The snapshot of folded rows: steps that started get tasks, and those of failed runs and skipped steps leave the queue."""
    ended = F.col("status") == "failed"
    gone = lambda t: (ended | (F.get(_statuses(flow), t["place"]) == "skipped")) & t["archived_at"].isNull()
    leaving = F.transform("tasks", lambda t: _task({"archived_at": F.when(gone(t), now).otherwise(t["archived_at"])}, t))
    kept = F.when(ended | F.array_contains(_statuses(flow), "skipped"), leaving).otherwise(F.col("tasks"))
    starts = [
        F.when((F.col("status") == "started") & (F.col(f"status{k}") == "started") & ~F.col(f"was{k}").eqNullSafe("started"), F.struct(F.lit(k).alias("place"), F.col(f"initial_tasks{k}").alias("n"), visible_at(now, F.lit(s.options.get("start_delay", 0))).cast("timestamp").alias("visible_at")))
        for k, s in enumerate(flow.steps)
    ]
    start = {"status": F.lit("queued"), "attempts_count": F.lit(0), "requeued_count": F.lit(0), "moved": F.lit(False)}
    fresh = lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: _task({**start, "place": s["place"], "task_index": i, "visible_at": s["visible_at"]}))
    made = F.flatten(F.transform(F.filter(F.array(*starts), lambda x: x.isNotNull()), fresh))
    wide = written(wide.withColumn("tasks", F.concat(kept, made)), "runs")
    return _views(flow, wide, _events(flow, wide, now))


def _settle(flow: Flow, rows: DataFrame, now: Column) -> Snapshot:
    """The snapshot after a report changed the steps and tasks of ``rows`` (``was`` tells what a step was).

    A run with a failed step fails before anything else of it moves.
    """
    bad = F.lit(False)
    for k in range(len(flow.steps)):
        bad = bad | F.coalesce(F.col(f"status{k}") == "failed", F.lit(False))
    # A failed run passes the fold untouched: it is no longer open.
    rows = rows.withColumns({"__new": F.lit(False), "__fails": (F.col("status") == "started") & bad})
    folded = _fold(flow, rows.withColumn("status", F.when(F.col("__fails"), "failed").otherwise(F.col("status"))), now)
    ended = F.when(F.col("__fails"), now).otherwise(F.col("ended_at"))
    folded = folded.withColumns({"ended_at": ended, "__ends": F.col("__ends") | F.col("__fails")}).drop("__fails")
    return _finish(flow, folded, now)


def start_runs(flow: Flow, inputs: DataFrame, now: Column) -> tuple[Snapshot, DataFrame]:
    """(snapshot after the start, rejected inputs): a root map rejects an input that is no array; null inputs are rejected."""
    root_map = any(s.kind == "map" and not s.depends_on for s in flow.steps)
    fits = F.col("input").isNotNull() & (F.json_array_length("input").isNotNull() if root_map else F.lit(True))
    fits = F.coalesce(fits, F.lit(False))
    none = lambda kind: F.lit(None).cast(kind)
    run = {"status": F.lit("started"), "output": none("string"), "started_at": now.cast("timestamp"), "ended_at": none("timestamp"), "__new": F.lit(True)}
    runs = inputs.filter(fits).select(F.col("run_id").cast("string").alias("run_id"), F.col("input")).withColumns(run)
    step = {"status": F.lit("created")}
    columns = {}
    for k, s in enumerate(flow.steps):
        step["initial_tasks"] = F.lit(1) if s.kind == "single" else none("int") if s.depends_on else F.json_array_length("input")
        columns |= {f"{f}{k}": step.get(f, none(kind)).cast(kind) for f, kind in _FIELDS.items()}
    columns["tasks"] = F.array().cast(_ARRAY)
    return _finish(flow, _fold(flow, runs.withColumns(columns), now), now), inputs.filter(~fits)


def _reported(snap: Snapshot, reports: DataFrame, value: str | None, facts, change) -> DataFrame:
    """The rows of a snapshot with ``tasks`` in order, each as ``change(task, x)`` makes it.

    ``x`` has the ``value`` that was reported and the conditions of ``facts(task, hit,
    step)``, decided once a task: ``hit`` tells of a report, ``step`` is the step's status.

    Reports come to their run as one array and are sorted in among its tasks, so
    that a task finds its own right before itself; of several, the last by value counts.
    The sizes that Spark expects of these columns are far too small, hence no broadcast,
    and partitions by the size that the rows have in memory.
    """
    rows, flow = _rows(snap), snap.flow
    no_value, step = F.lit(None).cast("string"), lambda t: F.get(_statuses(flow), t["place"])

    def changed(known: Column) -> Column:
        decided = F.transform(known, lambda x: F.struct(x["task"].alias("task"), x["value"].alias("value"), *[c.alias(f) for f, c in facts(x["task"], x["hit"], x["step"]).items()]))
        return F.transform(decided, lambda x: change(x["task"], x))

    if reports is snap.tasks and value is None:  # every task: nothing to look up
        return rows.withColumn("tasks", changed(F.transform("tasks", lambda t: F.struct(t.alias("task"), F.lit(True).alias("hit"), no_value.alias("value"), step(t).alias("step")))))
    key = {"place": _by_step(flow, flow.steps.index).cast("int"), "task_index": F.col("task_index").cast("int"), "value": no_value if value is None else F.col(value).cast("string")}
    found = reports.select("run_id", *[c.alias(f) for f, c in key.items()]).filter("place is not null and task_index is not null")
    rows = rows if _kept(snap) else written(rows, "rows")
    parts = _partitions((rows, _row_bytes(flow)))
    grouped = found.repartition(parts, "run_id").groupBy("run_id").agg(F.collect_list(F.struct(*key)).alias("__reports"))
    line = lambda x, kind, value, task: F.struct(x["place"].alias("place"), x["task_index"].alias("task_index"), F.lit(kind).alias("kind"), value.alias("value"), task.alias("task"))
    no_task = F.get(F.array().cast(_ARRAY), F.lit(0))
    told = F.transform("__reports", lambda r: line(r, 0, r["value"], no_task))
    held = F.transform("tasks", lambda t: line(t, 1, no_value, t))
    lines = F.sort_array(F.when(F.col("__reports").isNull(), held).otherwise(F.concat(told, held)))

    def own(x: Column, before: Column) -> Column:
        hit = F.coalesce((before["kind"] == 0) & (before["task_index"] == x["task_index"]) & (before["place"] == x["place"]), F.lit(False))
        return F.when(x["kind"] == 1, F.struct(x["task"].alias("task"), hit.alias("hit"), before["value"].alias("value"), step(x).alias("step")))

    paired = _let(lines, lambda all_: F.transform(all_, lambda x, i: own(x, F.get(all_, i - 1))))
    tasks = changed(F.filter(paired, lambda x: x.isNotNull()))
    return rows.repartition(parts, "run_id").join(grouped.hint("merge"), "run_id", "left").withColumn("tasks", tasks).drop("__reports")


def _steps_moved(flow: Flow, rows: DataFrame, summary) -> DataFrame:
    """Rows with ``__end`` of each step that had tasks moved: ``summary(step)`` of the step's tasks in order; ``was`` is what the step was."""
    rows = rows.withColumn("__moved", F.array_distinct(F.transform(F.filter("tasks", lambda t: t["moved"]), lambda t: t["place"])))
    ends = {f"__end{k}": F.when(F.array_contains("__moved", k), _let(F.filter("tasks", _of_step(k)), summary(s))) for k, s in enumerate(flow.steps)}
    return rows.withColumns({**ends, **{f"was{k}": F.col(f"status{k}") for k in range(len(flow.steps))}}).drop("__moved")


def start_tasks(snap: Snapshot, chosen: DataFrame, worker: str, now: Column) -> tuple[Snapshot, DataFrame]:
    """(snapshot, task records with their input) for queued tasks among ``chosen`` (run_id, step_slug, task_index).

    Only tasks of started steps in started runs start; a skipped parent has no
    key in the input, and ``flow_input`` is given to single root steps alone.
    ``snap.tasks`` itself as ``chosen`` means every task, without a join.
    """
    flow = snap.flow

    def facts(t: Column, hit: Column, step: Column) -> dict[str, Column]:
        return {"mine": F.coalesce(hit & (t["status"] == "queued") & (step == "started") & (F.col("status") == "started"), F.lit(False))}

    def change(t: Column, x: Column) -> Column:
        mine = x["mine"]
        lease = _at(flow, lambda s: visible_at(now, F.lit(flow.option(s, "timeout") + LEASE_SECONDS)).cast("timestamp"), t["place"])
        new = {
            "status": F.when(mine, "started").otherwise(t["status"]), "attempts_count": t["attempts_count"] + mine.cast("int"), "started_at": F.when(mine, now).otherwise(t["started_at"]),
            "visible_at": F.when(mine, lease).otherwise(t["visible_at"]), "worker": F.when(mine, worker).otherwise(t["worker"]), "moved": mine,
        }
        return _task(new, t)

    quiet = {"__new": F.lit(False), "__ends": F.lit(False)}
    wide = written(_reported(snap, chosen, None, facts, change).withColumns(quiet), "tasks")
    output = lambda p: F.when(F.col(f"status{p}") == "completed", F.coalesce(F.col(f"output{p}"), F.lit("null")))
    items, given = [], []
    for k, s in enumerate(flow.steps):
        parents, no_items = _parents(flow, s), F.lit(None).cast("array<string>")
        if s.kind == "map":
            # An array is read once a run, and only for a step that has tasks to start.
            array = F.try_variant_get(F.try_parse_json(output(parents[0]) if parents else F.col("input")), "$", "array<variant>")
            starts = F.exists(F.filter("tasks", _of_step(k)), lambda t: t["moved"])
            no_items = F.when(starts, F.transform(array, lambda v: F.to_json(v)))
        items.append(no_items)
        given.append(F.lit(None).cast("string") if s.kind == "map" else _object([(flow.steps[p].slug, output(p), F.col(f"status{p}") == "completed") for p in parents]) if parents else F.col("input"))
    is_map, plain_root = (lambda s: s.kind == "map"), (lambda s: s.kind == "single" and not s.depends_on)

    def record(t: Column, x: Column) -> Column:
        one = F.when(_at(flow, is_map, t["place"]), F.get(F.get(x["items"], t["place"]), t["task_index"])).otherwise(F.get(x["given"], t["place"]))
        return F.struct(_at(flow, lambda s: s.slug, t["place"]).alias("step_slug"), t["task_index"].alias("task_index"), one.alias("input"), F.when(_at(flow, plain_root, t["place"]), F.col("input")).alias("flow_input"))

    mine = F.filter("tasks", lambda t: t["moved"])
    made = _let(F.struct(F.array(*items).alias("items"), F.array(*given).alias("given")), lambda x: F.transform(mine, lambda t: record(t, x)))
    records = wide.select("run_id", F.explode(made).alias("r")).select("run_id", "r.*")
    return _views(flow, wide, snap.runs.sparkSession.createDataFrame([], EVENTS)), records


def complete_tasks(snap: Snapshot, outputs: DataFrame, now: Column) -> Snapshot:
    """Apply completions (run_id, step_slug, task_index, output): late ones and those of failed runs do nothing.

    A report on a step that is no longer started only takes the message from the
    queue.  A single step that feeds a map must give an array; else step and run
    fail, whatever the step's mode.
    """
    flow = snap.flow
    feeds = lambda s: s.kind == "single" and any(c.kind == "map" and s.slug in c.depends_on for c in flow.steps)

    def facts(t: Column, hit: Column, step: Column) -> dict[str, Column]:
        live = hit & (F.col("status") != "failed")
        return {"mine": F.coalesce(live & (step == "started") & (t["status"] == "started"), F.lit(False)), "late": F.coalesce(live & (step != "started"), F.lit(False))}

    def change(t: Column, x: Column) -> Column:
        mine, kind = x["mine"], json_kind(x["value"])
        wrong = mine & _at(flow, feeds, t["place"]) & (kind != "array") if any(feeds(s) for s in flow.steps) else F.lit(False)
        new = {
            "status": F.when(~mine, t["status"]).when(wrong, "failed").otherwise("completed"), "output": F.when(mine, x["value"]).otherwise(t["output"]),
            "error": F.when(wrong, F.concat(F.lit("[TYPE_VIOLATION] a map step needs an array, not "), kind)).otherwise(t["error"]),
            "ended_at": F.when(mine, now).otherwise(t["ended_at"]), "archived_at": F.when((mine | x["late"]) & t["archived_at"].isNull(), now).otherwise(t["archived_at"]), "moved": mine,
        }
        return _task(new, t)

    def summary(s: Step):
        def of(ts: Column) -> Column:
            left = F.size(F.filter(ts, lambda t: t["status"] != "completed"))
            array = F.concat(F.lit("["), F.array_join(F.transform(ts, lambda t: F.coalesce(t["output"], F.lit("null"))), ","), F.lit("]"))
            bad = F.array_min(F.transform(F.filter(ts, lambda t: t["moved"] & (t["status"] == "failed")), lambda t: t["error"])) if feeds(s) else F.lit(None).cast("string")
            return F.struct(left.alias("left"), bad.alias("bad"), (array if s.kind == "map" else F.array_max(F.transform(ts, lambda t: t["output"]))).alias("output"))

        return of

    rows = _steps_moved(flow, _reported(snap, outputs, "output", facts, change), summary)
    new = {}
    for k in range(len(flow.steps)):
        end, old = F.col(f"__end{k}"), lambda f, k=k: F.col(f"{f}{k}")
        bad = end["bad"].isNotNull()
        done = F.coalesce(~bad & (end["left"] == 0), F.lit(False))
        new |= {
            f"status{k}": F.when(bad, "failed").when(done, "completed").otherwise(old("status")), f"remaining_tasks{k}": F.coalesce(end["left"], old("remaining_tasks")),
            f"output{k}": F.when(done, end["output"]).otherwise(old("output")), f"error{k}": F.coalesce(end["bad"], old("error")), f"ended_at{k}": F.when(bad | done, now).otherwise(old("ended_at")),
        }
    return _settle(flow, rows.withColumns(new).drop(*[f"__end{k}" for k in range(len(flow.steps))]), now)


def fail_tasks(snap: Snapshot, failures: DataFrame, now: Column) -> Snapshot:
    """Apply failures (run_id, step_slug, task_index, error): queued again with backoff, or by the step's mode.

    In a run that has failed, a started task is marked failed and nothing else
    moves; a report on a step that is no longer started only archives its message.
    """
    flow = snap.flow

    def facts(t: Column, hit: Column, step: Column) -> dict[str, Column]:
        started, none = hit & (t["status"] == "started"), F.lit(False)
        mine = F.coalesce(started & (F.col("status") == "started") & (step == "started"), none)
        left = t["attempts_count"] < _at(flow, lambda s: flow.option(s, "max_attempts"), t["place"])
        return {"again": mine & left, "spent": mine & ~left, "late": F.coalesce(started & (F.col("status") == "failed"), none), "over": F.coalesce(hit & (step != "started"), none)}

    def change(t: Column, x: Column) -> Column:
        again, ended = x["again"], x["spent"] | x["late"]
        delay = retry_delay(_at(flow, lambda s: flow.option(s, "base_delay"), t["place"]), t["attempts_count"])
        new = {
            "status": F.when(again, "queued").when(ended, "failed").otherwise(t["status"]), "error": F.when(again | ended, x["value"]).otherwise(t["error"]),
            "visible_at": F.when(again, visible_at(now, delay)).otherwise(t["visible_at"]), "started_at": F.when(~again, t["started_at"]),
            "ended_at": F.when(ended, now).otherwise(t["ended_at"]), "archived_at": F.when((ended | x["over"]) & t["archived_at"].isNull(), now).otherwise(t["archived_at"]), "moved": x["spent"],
        }
        return _task(new, t)

    # A step has failed by the first of its spent tasks.
    rows = _steps_moved(flow, _reported(snap, failures, "error", facts, change), lambda _: lambda ts: F.struct(F.get(F.filter(ts, lambda t: t["moved"]), F.lit(0))["error"].alias("error")))
    new = {}
    for k, s in enumerate(flow.steps):
        end, old, hard = F.col(f"__end{k}"), lambda f, k=k: F.col(f"{f}{k}"), s.when_exhausted == "fail"
        hit = end.isNotNull()
        new |= {f"status{k}": F.when(hit, "failed" if hard else "skipped").otherwise(old("status")), f"error{k}": F.when(hit, end["error"]).otherwise(old("error")), f"ended_at{k}": F.when(hit, now).otherwise(old("ended_at"))}
        if not hard:
            new |= {f"skip_reason{k}": F.when(hit, "handler_failed").otherwise(old("skip_reason")), f"remaining_tasks{k}": F.when(~hit, old("remaining_tasks"))}
    return _settle(flow, rows.withColumns(new).drop(*[f"__end{k}" for k in range(len(flow.steps))]), now)


def prune(runs: DataFrame, children: list[DataFrame], before: Column) -> tuple[DataFrame, list[DataFrame]]:
    """Runs ended before a moment go, and so do the rows of their children; open runs stay."""
    old = runs.filter(F.col("status").isin("completed", "failed") & (F.col("ended_at") < before)).select("run_id")
    return runs.join(old, "run_id", "left_anti"), [c.join(old, "run_id", "left_anti") for c in children]


def prune_snapshot(snap: Snapshot, before: Column) -> Snapshot:
    """A snapshot without the runs that ended before a moment, their states and their tasks."""
    runs, (states, tasks) = prune(snap.runs, [snap.states, snap.tasks], before)
    return Snapshot(snap.flow, runs, states, tasks, snap.events)
