"""Batch compiler: a flow over a DataFrame of runs becomes one DataFrame plan.

One row a run; each step adds a struct column ``<step>`` of
``status, output, skip_reason, error, attempts``.  The graph is static, so what a
workflow engine does by counters and loops is unrolled when the plan is built.
Handlers are Column expressions (no shuffle, no Python) or Python functions
that Arrow carries in batches.

Failure order is by waves of longest path: in a wave all conditions are decided
first, then its tasks run; after a failure later waves stay ``created``.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.scalars import json_object
from loomspark.plans.containment import condition_met, contains
from loomspark.plans.flow import Flow, Step

UNMET, HANDLER, DEPENDENCY = "condition_unmet", "handler_failed", "dependency_skipped"
NOT_MET_ERROR = "Condition not met"
VIOLATION = "[TYPE_VIOLATION] a map step needs an array"


@dataclass
class Input:
    """What a handler sees: the run's input, its dependencies' outputs, and for maps the element."""

    flow_input: Column
    deps: dict[str, Column]
    item: Column | None = None
    index: Column | None = None


@dataclass
class Outcome:
    """A Column handler that can fail: where ``ok`` is false, ``error`` says why."""

    value: Column
    ok: Column
    error: Column | str = "handler failed"


@dataclass
class PythonHandler:
    """A Python function of plain values, tried ``max_attempts`` times per task.

    ``fn(value, context)`` gets the element (map), the input (root) or a dict of
    the dependencies' outputs; ``context`` has run_id, step, task_index, attempt.
    A raised exception is a failed attempt.
    """

    fn: Callable[[Any, dict], Any]
    returns: str


def _run_task(fn: Callable, value: Any, context: dict, attempts: int) -> tuple[bool, Any, str | None, int]:
    error = None
    for attempt in range(1, attempts + 1):
        try:
            return True, fn(value, {**context, "attempt": attempt}), None, attempt
        except Exception as e:  # the handler's failure is data
            error = str(e) or type(e).__name__
    return False, None, error, attempts


def _plain(value: Any) -> Any:
    """Rows as dicts, so that handlers see plain values."""
    if isinstance(value, T.Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _python_single(handler: PythonHandler, slug: str, attempts: int):
    @F.udf(f"struct<ok:boolean,value:{handler.returns},error:string,attempts:int>", useArrow=True)
    def call(run_id, ready, value):
        if not ready:
            return None
        return _run_task(handler.fn, _plain(value), {"run_id": run_id, "step": slug, "task_index": 0}, attempts)

    return call.asNondeterministic()


def _python_map(handler: PythonHandler, slug: str, attempts: int):
    @F.udf(f"struct<ok:boolean,value:array<{handler.returns}>,error:string,attempts:int>", useArrow=True)
    def call(run_id, ready, items):
        if not ready or items is None:
            return None
        out, most = [], 0
        for k, item in enumerate(items):
            ok, value, error, used = _run_task(handler.fn, _plain(item), {"run_id": run_id, "step": slug, "task_index": k}, attempts)
            most = max(most, used)
            if not ok:
                return False, None, error, used
            out.append(value)
        return True, out, None, most

    return call.asNondeterministic()


def _completed(slug: str) -> Column:
    return F.col(f"`{slug}`.status") == "completed"


def _output(slug: str) -> Column:
    return F.col(f"`{slug}`.output")


def _met(df: DataFrame, step: Step, input_col: str) -> Column:
    """Whether the step's condition holds, on the run's input or on its dependencies' outputs."""
    if not step.depends_on:
        return condition_met(F.col(input_col), df.schema[input_col].dataType, step.if_, step.if_not)

    def on_deps(pattern: dict) -> Column:
        out = F.lit(True)
        for key, sub in pattern.items():
            if key not in step.depends_on:
                return F.lit(False)
            kind = df.schema[key].dataType["output"].dataType
            out = out & _completed(key) & contains(_output(key), kind, sub)
        return out

    met = F.lit(True) if step.if_ is None else on_deps(step.if_)
    return met if step.if_not is None else met & ~on_deps(step.if_not)


def _state(status: Column, output: Column, reason: Column, error: Column, attempts: Column) -> Column:
    return F.struct(status.alias("status"), output.alias("output"), reason.alias("skip_reason"), error.alias("error"), attempts.cast("int").alias("attempts"))


def run_batch(flow: Flow, runs: DataFrame, run_col: str = "run_id", input_col: str = "input") -> DataFrame:
    """Run a flow for every row of ``runs``.

    Adds a struct column for each step, ``run_status`` (completed or failed) and
    ``run_output`` (JSON object of the completed leaves, null where there is
    none).  Columns of ``runs`` stay; one named like a step is an error.  A root
    map needs an array input; a null array is an error of the run's map step.
    """
    clash = {s.slug for s in flow.steps} & set(runs.columns)
    if clash:
        raise ValueError(f"columns have the names of steps: {sorted(clash)}")
    if any(s.kind == "map" and not s.depends_on for s in flow.steps) and not isinstance(runs.schema[input_col].dataType, T.ArrayType):
        raise ValueError("a root map needs an array as input")
    children = {s.slug: [c for c in flow.steps if s.slug in c.depends_on] for s in flow.steps}
    # __open: whether the run has not failed; __c_<step>: the step's skip takes its descendants along.
    df = runs.withColumn("__open", F.lit(True))
    for wave in flow.waves():
        gate, unmet = {}, {}
        for s in wave:
            inherited = F.lit(False)
            for d in s.depends_on:
                inherited = inherited | F.col(f"`__c_{d}`")
            gate[s.slug] = inherited
            unmet[s.slug] = ~_met(df, s, input_col)
        df = df.withColumns({f"__i_{s.slug}": gate[s.slug] for s in wave} | {f"__u_{s.slug}": unmet[s.slug] for s in wave})
        blocked = F.lit(None).cast("string")
        for s in reversed(wave):
            if s.when_unmet == "fail":
                blocked = F.when(F.col("__open") & ~F.col(f"`__i_{s.slug}`") & F.col(f"`__u_{s.slug}`"), s.slug).otherwise(blocked)
        df = df.withColumn("__blocked", blocked)
        for s in wave:
            df = _add_step(df, flow, s, run_col, input_col, any(c.kind == "map" for c in children[s.slug]))
        failed = F.col("__blocked").isNotNull()
        for s in wave:
            failed = failed | (F.col(f"`{s.slug}`.status") == "failed")
        df = df.withColumn("__open", F.col("__open") & ~failed)
    done = F.lit(False)
    for s in flow.leaves():
        done = done | _completed(s.slug)
    output = json_object([(s.slug, _output(s.slug), _completed(s.slug)) for s in sorted(flow.leaves(), key=lambda s: s.slug)])
    df = df.withColumn("run_status", F.when(F.col("__open"), "completed").otherwise("failed")).withColumn("run_output", F.when(F.col("__open") & done, output))
    hidden = ["__open", "__blocked", *[f"__{k}_{s.slug}" for s in flow.steps for k in "iuc"]]
    return df.drop(*hidden)


def _add_step(df: DataFrame, flow: Flow, s: Step, run_col: str, input_col: str, feeds_map: bool) -> DataFrame:
    inherited, unmet = F.col(f"`__i_{s.slug}`"), F.col(f"`__u_{s.slug}`")
    ready = F.col("__open") & ~inherited & F.col("__blocked").isNull() & ~unmet
    deps = {d: _output(d) for d in s.depends_on}
    attempts = flow.option(s, "max_attempts")
    given, python = None, isinstance(s.handler, PythonHandler)
    raw = f"__r_{s.slug}"
    if s.kind == "map":
        if s.depends_on:
            parent, kind = s.depends_on[0], df.schema[s.depends_on[0]].dataType["output"].dataType
            if not isinstance(kind, T.ArrayType):
                raise ValueError(f"map step {s.slug!r} needs an array from {parent!r}")
            items = F.when(_completed(parent), _output(parent)).otherwise(F.array().cast(kind))  # of a skipped parent: empty
        else:
            items = F.col(input_col)
        if python:
            df = df.withColumn(raw, _python_map(s.handler, s.slug, attempts)(F.col(run_col), ready, items))
        else:
            seen: list = []

            def one(item: Column, index: Column) -> Column:
                result = s.handler(Input(F.col(input_col), deps, item, index))
                seen.append(isinstance(result, Outcome))
                if isinstance(result, Outcome):
                    return F.struct(F.coalesce(result.ok, F.lit(False)).alias("ok"), result.value.alias("value"), (F.lit(result.error) if isinstance(result.error, str) else result.error).alias("error"))
                return F.struct(F.lit(True).alias("ok"), result.alias("value"), F.lit(None).cast("string").alias("error"))

            df = df.withColumn(raw, F.when(ready, F.transform(items, one)))
            rows = F.col(f"`{raw}`")
            ok = F.forall(rows, lambda x: x["ok"])
            bad = F.get(F.filter(rows, lambda x: ~x["ok"]), F.lit(0))["error"]
            given = (rows.isNotNull() & ok, F.transform(rows, lambda x: x["value"]), F.when(rows.isNull(), F.lit("input is not an array")).otherwise(bad), F.when(F.size(items) > 0, F.when(ok, 1).otherwise(attempts)))
    elif python:
        value = F.struct(*[F.when(_completed(d), v).alias(d) for d, v in deps.items()]) if deps else F.col(input_col)
        df = df.withColumn(raw, _python_single(s.handler, s.slug, attempts)(F.col(run_col), ready, value))
    else:
        result = s.handler(Input(F.col(input_col), deps))
        if isinstance(result, Outcome):
            ok = F.coalesce(result.ok, F.lit(False))
            given = (ok, result.value, F.lit(result.error) if isinstance(result.error, str) else result.error, F.when(ok, 1).otherwise(attempts))
        else:
            given = (F.lit(True), result, F.lit(None).cast("string"), F.lit(1))
    if python:
        c = F.col(f"`{raw}`")
        given = (F.coalesce(c["ok"], F.lit(False)), c["value"], F.coalesce(c["error"], F.lit("input is not an array")), c["attempts"])
    ok, value, error, used = given
    violated = ok & value.isNull() if feeds_map else F.lit(False)  # a typed column is an array or null
    done = ready & ok & ~violated
    broken = ready & ~ok & ~violated
    skips = s.when_exhausted != "fail"
    status = (
        F.when(inherited, "skipped").when(F.col("__blocked") == s.slug, "failed").when(~F.col("__open") | F.col("__blocked").isNotNull(), "created").when(unmet, "skipped")
        .when(violated, "failed").when(broken, "skipped" if skips else "failed").otherwise("completed")
    )
    reason = F.when(inherited, DEPENDENCY).when(ready, F.when(broken & F.lit(skips), HANDLER)).when(F.col("__open") & F.col("__blocked").isNull() & unmet, UNMET)
    message = F.when(inherited, None).when(F.col("__blocked") == s.slug, NOT_MET_ERROR).when(ready & violated, VIOLATION).when(broken, error)
    df = df.withColumn(s.slug, _state(status, F.when(done, value), reason, message, F.when(ready, used)))
    cascade = inherited
    own = F.col("__open") & ~inherited & F.col("__blocked").isNull()
    if s.when_unmet == "skip-cascade":
        cascade = cascade | own & unmet
    if s.when_exhausted == "skip-cascade":
        cascade = cascade | (F.col(f"`{s.slug}`.skip_reason") == HANDLER)
    return df.withColumn(f"__c_{s.slug}", F.coalesce(cascade, F.lit(False))).drop(raw)


def step_states(flow: Flow, done: DataFrame, run_col: str = "run_id") -> DataFrame:
    """The result of ``run_batch`` as rows: run, step_slug, step_index, status, output (JSON), skip_reason, error."""
    from loomspark.functions.scalars import json_text

    rows = [
        F.struct(
            F.lit(s.slug).alias("step_slug"), F.lit(k).alias("step_index"), F.col(f"`{s.slug}`.status").alias("status"),
            F.when(_completed(s.slug), json_text(_output(s.slug))).alias("output"), F.col(f"`{s.slug}`.skip_reason").alias("skip_reason"), F.col(f"`{s.slug}`.error").alias("error"),
        )
        for k, s in enumerate(flow.steps)
    ]
    return done.select(run_col, F.explode(F.array(*rows)).alias("s")).select(run_col, "s.*")


def run_events(flow: Flow, done: DataFrame, run_col: str = "run_id") -> DataFrame:
    """The events that a run leaves, in order: started, then each step by wave, then the run's end."""
    wave = {s.slug: w for w, steps in enumerate(flow.waves()) for s in steps}
    event = lambda seq, kind, slug, status, when: F.when(when, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("event_type"), F.lit(slug).cast("string").alias("step_slug"), status.alias("status")))
    rows = [event(0, "run:started", None, F.lit("started"), F.lit(True))]
    for k, s in enumerate(flow.steps):
        status = F.col(f"`{s.slug}`.status")
        base = 1 + wave[s.slug] * 2 * (len(flow.steps) + 1)
        # An empty map and a skipped step never start.
        started = status.isin("completed", "failed") & F.col(f"`{s.slug}`.attempts").isNotNull()
        rows.append(event(base + k, "step:started", s.slug, F.lit("started"), started))
        for end in ("completed", "failed", "skipped"):
            rows.append(event(base + len(flow.steps) + 1 + k, f"step:{end}", s.slug, F.lit(end), status == end))
    last = 2 + 2 * (len(wave) + 1) * (len(flow.steps) + 1)
    for end in ("completed", "failed"):
        rows.append(event(last, f"run:{end}", None, F.lit(end), F.col("run_status") == end))
    return done.select(run_col, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("e")).select(run_col, "e.*")


def plan_json(flow: Flow) -> str:
    """The compiled order as JSON: waves of step slugs."""
    return json.dumps({"flow": flow.slug, "waves": [[s.slug for s in w] for w in flow.waves()]})
