import json
import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import definitions, queue, state, workers
from loomspark.plans.flow import Flow



def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")

FLOW = (
    Flow("f", {"max_attempts": 2})
    .step("a", None)
    .map("m", None, "a")
    .step("opt", None, ["a"], if_={"a": [7]}, when_unmet="skip-cascade")
    .step("after", None, ["opt"])
    .step("z", None, ["m"], when_exhausted="skip")
)


def frame(spark, rows, value):
    return spark.createDataFrame(rows, f"run_id string, step_slug string, task_index int, {value} string")


def begin(spark, *inputs):
    return state.start_runs(FLOW, spark.createDataFrame([(str(k), x) for k, x in enumerate(inputs)], "run_id string, input string"), now())[0]


def start_all(snap, spark):
    tasks = snap.tasks.select("run_id", "step_slug", "task_index")
    return state.start_tasks(snap, tasks, "w", now())


def states(snap):
    return {(r.run_id, r.step_slug): r for r in snap.states.collect()}


@pytest.fixture(scope="module")
def finished(spark):
    snap = begin(spark, '{"x":1}', '{"x":2}')
    snap, records = start_all(snap, spark)
    first = {r.run_id: r for r in records.collect()}
    assert json.loads(first["0"].input) == {"x": 1} and first["0"].flow_input
    snap = state.complete_tasks(snap, frame(spark, [("0", "a", 0, "[5,6]"), ("1", "a", 0, "[]")], "output"), now())
    snap, records = start_all(snap, spark)
    return snap, {(r.run_id, r.step_slug, r.task_index): r.input for r in records.collect()}


def test_fan_out_skip_cascade_and_empty_map(finished):
    snap, records = finished
    got = states(snap)
    assert (got["0", "m"].status, got["0", "m"].initial_tasks) == ("started", 2)
    assert (got["0", "opt"].skip_reason, got["0", "after"].skip_reason) == ("condition_unmet", "dependency_skipped")
    assert (got["1", "m"].status, got["1", "m"].output, got["1", "z"].status) == ("completed", "[]", "started")
    assert records["0", "m", 1] == "6" and json.loads(records["1", "z", 0]) == {"m": []}


def test_ordered_gather_and_run_completion(spark, finished):
    snap, _ = finished
    snap = state.complete_tasks(snap, frame(spark, [("0", "m", 1, "60"), ("0", "m", 0, "50"), ("1", "z", 0, '"end"'), ("1", "z", 9, "1")], "output"), now())
    assert states(snap)["0", "m"].output == "[50,60]"
    assert {r.run_id: (r.status, r.output) for r in snap.runs.collect()} == {"0": ("started", None), "1": ("completed", '{"z":"end"}')}


def test_failure_modes(spark, finished):
    snap, _ = finished
    once = state.fail_tasks(snap, frame(spark, [("0", "m", 0, "bad"), ("1", "z", 0, "bad")], "error"), now())
    tasks = {(r.run_id, r.step_slug, r.task_index): r for r in once.tasks.collect()}
    assert (tasks["1", "z", 0].status, tasks["1", "z", 0].error, str(tasks["1", "z", 0].visible_at)) == ("queued", "bad", "2024-01-01 00:00:10")
    again, _ = start_all(once, spark)
    end = state.fail_tasks(again, frame(spark, [("0", "m", 0, "bad"), ("1", "z", 0, "bad")], "error"), now())
    got = states(end)
    assert (got["1", "z"].status, got["1", "z"].skip_reason, got["0", "m"].status) == ("skipped", "handler_failed", "failed")
    assert {r.run_id: r.status for r in end.runs.collect()} == {"0": "failed", "1": "completed"}


def test_type_violation_and_rejected_inputs(spark):
    snap, _ = start_all(begin(spark, "1"), spark)
    snap = state.complete_tasks(snap, frame(spark, [("0", "a", 0, '{"no":1}')], "output"), now())
    assert states(snap)["0", "a"].error.startswith("[TYPE_VIOLATION]") and snap.runs.first().status == "failed"
    root = Flow("r").map("m", None)
    ok, bad = state.start_runs(root, spark.createDataFrame([("1", "[1]"), ("2", "{}"), ("3", None)], "run_id string, input string"), now())
    assert [r.run_id for r in ok.runs.collect()] == ["1"] and {r.run_id for r in bad.collect()} == {"2", "3"}


def test_queue_and_workers(spark):
    q = spark.createDataFrame([("q", k, 0, "m") for k in range(5)], "queue_name string, msg_id long, read_ct int, message string").select("queue_name", "msg_id", "read_ct", now().alias("enqueued_at"), now().alias("vt"), "message")
    assert [r.msg_id for r in queue.read_visible(q, now(), 2, 30).collect()] == [0, 1]
    with pytest.raises(ValueError):
        queue.set_visibility(q, [1], [], now())
    assert queue.set_visibility(q, [], [], now()).count() == 0
    f = spark.createDataFrame([("f", True, 6, None)], "function_name string, enabled boolean, debounce_seconds int, last_invoked_at timestamp")
    assert workers.track(workers.track(f, "g", now()), "g", now()).count() == 2


def test_definitions(spark):
    steps = spark.createDataFrame([("f", "a", "single", 0)], "flow_slug string, step_slug string, step_type string, step_index int")
    deps = spark.createDataFrame([], "flow_slug string, dep_slug string, step_slug string")
    steps, deps = definitions.add_step(steps, deps, "f", "b", ["a"], "map")
    steps, deps = definitions.add_step(steps, deps, "f", "b", ["a"], "map")
    assert json.loads(definitions.shape_json(steps, deps).first().shape)["steps"][1] == {"slug": "b", "stepType": "map", "dependencies": ["a"]}
    with pytest.raises(ValueError):
        definitions.add_step(steps, deps, "f", "c", ["a", "b"], "map")
    assert definitions.delete_flow({"s": steps}, "f")["s"].count() == 0


def test_a_chain_of_any_depth_plans_the_same_joins(spark):
    """Starts and completions join a fixed number of times, and an empty array runs through 49 maps in one call."""
    flow = Flow("chain").map("m0", None)
    for k in range(1, 49):
        flow = flow.map(f"m{k}", None, f"m{k - 1}")
    snap, _ = state.start_runs(flow, spark.createDataFrame([("e", "[]"), ("x", "[1]")], "run_id string, input string"), now())
    assert {(r.run_id, r.status, r.output) for r in snap.runs.collect()} == {("e", "completed", '{"m48":[]}'), ("x", "started", None)}
    assert snap.states.filter("run_id = 'e' and status = 'completed'").count() == 49
    for frame_ in (snap.runs, snap.states, snap.tasks):
        assert frame_._jdf.queryExecution().analyzed().toString().count("Join") == 0


def test_events_and_messages(spark):
    snap, _ = start_all(begin(spark, "1"), spark)
    snap = state.complete_tasks(snap, frame(spark, [("0", "a", 0, "[3]")], "output"), now())
    got = [(r.event_type, r.step_slug) for r in snap.events.orderBy("seq").collect()]
    assert got == [("step:completed", "a"), ("step:started", "m"), ("step:skipped", "opt"), ("step:skipped", "after")]
    done = next(r for r in snap.events.collect() if r.event_type == "step:completed")
    assert json.loads(done.payload)["output"] == "[3]"
    assert [r.msg_id for r in state.messages(snap).collect()] == ["0/m/0"]
    # Late reports: the message goes, nothing else moves; in a failed run a started task fails.
    again = state.complete_tasks(snap, frame(spark, [("0", "a", 0, "[9]")], "output"), now())
    assert states(again)["0", "a"].output == "[3]" and again.events.count() == 0


def test_a_failed_condition_starts_nothing(spark):
    flow = Flow("g").step("a", None).step("s", None, if_={"x": 1}).step("t", None, ["s"], if_={"s": 1}, when_unmet="fail")
    snap, _ = state.start_runs(flow, spark.createDataFrame([("r", '{"x":2}')], "run_id string, input string"), now())
    assert {k[1]: v.status for k, v in states(snap).items()} == {"a": "created", "s": "skipped", "t": "failed"}
    assert snap.runs.first().status == "failed" and snap.tasks.count() == 0
    assert [r.event_type for r in snap.events.orderBy("seq").collect()] == ["run:started", "step:skipped", "step:failed", "run:failed"]


def test_requeue_and_prune(spark):
    snap, _ = start_all(begin(spark, "1"), spark)
    later = lambda n: F.lit(f"2024-01-01 0{n}:00:00").cast("timestamp")
    for n in range(1, 4):
        snap = state.requeue(snap, later(n))
        row = snap.tasks.first()
        assert (row.status, row.worker, row.requeued_count) == ("queued", None, n)
        snap, _ = state.start_tasks(snap, snap.tasks, "w", later(n))
    row = state.requeue(snap, later(5)).tasks.first()
    assert (row.status, row.requeued_count) == ("started", 3) and row.permanently_stalled_at and row.archived_at
    failed = state.fail_tasks(snap, frame(spark, [("0", "a", 0, "x")], "error"), now())
    failed, _ = state.start_tasks(failed, failed.tasks, "w", now())
    assert state.prune_snapshot(failed, later(9)).runs.count() == failed.runs.filter("status = 'started'").count()


def test_full_definitions(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    flows = definitions.create_flow(definitions.create_flow(empty(definitions.FLOWS), "f", timeout=9), "f", timeout=80)
    assert [tuple(r) for r in flows.collect()] == [("f", 3, 5, 9)]
    steps, deps = definitions.add_step(empty(definitions.STEPS), empty(definitions.DEPS), "f", "a", [], max_attempts=7)
    steps, deps = definitions.add_step(steps, deps, "f", "b", ["a"], "map", if_={"a": [1]}, when_unmet="fail")
    with pytest.raises(ValueError):
        definitions.add_step(steps, deps, "f", "run", [])
    shapes = definitions.shape_json(steps, deps)
    one = json.loads(shapes.first().shape)["steps"][1]
    assert one["requiredInputPattern"] == {"defined": True, "value": {"a": [1]}} and one["whenUnmet"] == "fail"
    assert [(r.step_slug, r.max_attempts) for r in definitions.effective_options(flows, steps).orderBy("step_slug").collect()] == [("a", 7), ("b", 3)]
    _, again, edges = definitions.from_shapes(shapes)
    assert definitions.field_differences(shapes, definitions.shape_json(again, edges)).count() == 0
    assert definitions.read_definition(flows, steps, "f").count() == 1 and definitions.read_definition(flows, steps, "none").count() == 0


def test_closure_ends_and_rejects_cycles(spark):
    from loomspark.operators import graph

    chain = spark.createDataFrame([(f"s{k}", f"s{k + 1}") for k in range(6)], "dep_slug string, step_slug string")
    assert graph.descendants(chain).count() == 21
    with pytest.raises(ValueError):
        graph.descendants(spark.createDataFrame([("a", "b"), ("b", "a")], "dep_slug string, step_slug string"))


def test_exact_quantiles(spark):
    import numpy as np

    from loomspark.functions.quantiles import exact_quantiles

    values = [float(v) for v in np.random.default_rng(4).integers(0, 50, 997)] + [None]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", [0, 0.25, 0.5, 0.99, 1], list("abcde")).first()
    assert np.allclose(list(got), np.quantile(values[:-1], [0, 0.25, 0.5, 0.99, 1]))
    assert list(exact_quantiles(spark.createDataFrame([], "x double"), "x", [0.5], ["m"]).first()) == [None]


def test_events_after_a_snapshot(spark):
    from loomspark.operators import events

    snap = spark.createDataFrame([("a", "completed", 5), ("b", "started", 5)], "k string, status string, at int")
    log = spark.createDataFrame([("a", "failed", 9), ("b", "completed", 4), ("b", "failed", 7), ("c", "started", 1)], "k string, status string, at int")
    got = events.apply_events(snap, log, ["k"], events.RUN_RANK, events.RUN_TERMINAL)
    assert {r.k: r.status for r in got.collect()} == {"a": "completed", "b": "failed", "c": "started"}


def test_worker_settings():
    from loomspark.plans import config

    assert (config.QueueWorker().retry_max_delay, config.FlowWorker().visibility_timeout) == (300, 5)
    once = config.schedule({}, config.ENSURE_WORKERS)
    assert config.schedule(once, config.ENSURE_WORKERS) == once
    assert config.context("r", "s", 0, 1, config.FlowWorker())["worker_config"].batch_size == 10


def _plans(monkeypatch):
    """The plans of what is written from now on."""
    found, real = [], state.written

    def noted(df, name):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(state, "written", noted)
    return found


def test_a_call_joins_once_by_run_and_broadcasts_nothing(spark, monkeypatch):
    snap, _ = start_all(begin(spark, "1", "2"), spark)
    for call, value in ((state.complete_tasks, "output"), (state.fail_tasks, "error")):
        found = _plans(monkeypatch)
        call(snap, frame(spark, [("0", "a", 0, "[3]")], value), now())
        assert len(found) == 1 and found[0].count("SortMergeJoin") == found[0].count("Join") == 1
    found = _plans(monkeypatch)
    state.start_tasks(snap, snap.tasks, "w", now())
    assert len(found) == 1 and "Exchange" not in found[0]


def test_the_status_of_a_run_comes_with_its_steps(spark):
    snap, _ = start_all(begin(spark, "1", "2"), spark)
    snap = state.complete_tasks(snap, frame(spark, [("0", "a", 0, "7")], "output"), now())
    steps = state.states_of_runs(snap)
    assert "Join" not in steps._jdf.queryExecution().executedPlan().toString()
    assert {(r.run_id, r.run_status) for r in steps.collect()} == {("0", "failed"), ("1", "started")} and steps.count() == 10


def test_reports_of_some_tasks_of_a_wide_map(spark):
    """Reports out of order, twice, on tasks that are not there; the same from plain tables as from a call's rows."""
    flow = Flow("wide", {"max_attempts": 1}).map("m", None).step("z", None, ["m"])
    snap, _ = state.start_runs(flow, spark.createDataFrame([("r", json.dumps(list(range(300)))), ("q", "[1]")], "run_id string, input string"), now())
    snap, records = state.start_tasks(snap, snap.tasks, "w", now())
    assert {(r.run_id, r.task_index): r.input for r in records.collect()} == {("r", k): str(k) for k in range(300)} | {("q", 0): "1"}
    some = [("r", "m", k, str(k)) for k in (299, 7, 7, 150, 0, 300)] + [("r", "no", 0, "1"), ("x", "m", 0, "1"), ("q", "m", None, "1")]
    plain = state.Snapshot(flow, snap.runs.select("*"), snap.states.select("*"), snap.tasks.select("*"))
    for start in (snap, plain):
        part = state.complete_tasks(start, frame(spark, some, "output"), now())
        assert {(r.run_id, r.task_index) for r in part.tasks.filter("status = 'completed'").collect()} == {("r", k) for k in (0, 7, 150, 299)}
        assert (states(part)["r", "m"].remaining_tasks, states(part)["r", "m"].status, states(part)["q", "m"].remaining_tasks) == (296, "started", 1)
        done = state.complete_tasks(part, frame(spark, [("r", "m", k, str(k)) for k in range(299, -1, -1)], "output"), now())
        assert json.loads(states(done)["r", "m"].output) == list(range(300)) and states(done)["r", "z"].status == "started"
        assert done.tasks.filter("archived_at is null").count() == 2


def test_a_join_has_partitions_by_the_size_of_its_rows_in_memory(spark, monkeypatch):
    """Wide rows of a few bytes on disk are not merged into one partition, nor read by one task; results are the same."""
    from loomspark import session

    flow = Flow("sized", {"max_attempts": 1}).map("m", None, when_exhausted="skip").step("z", None, ["m"])
    inputs = spark.range(3000).selectExpr("cast(id as string) as run_id", "'[1,2,3]' as input").coalesce(1)
    snap, records = state.start_tasks(first := state.start_runs(flow, inputs, now())[0], first.tasks, "w", now())
    failures = records.filter("task_index = 1 and cast(run_id as int) % 2 = 0").select(*state.KEYS, F.lit("bad").alias("error"))
    want = state.fail_tasks(snap, failures, now())
    monkeypatch.setattr(state, "_PART_BYTES", 100_000)
    monkeypatch.setattr(session, "FILE_VALUES", 1000)
    plain = state.Snapshot(flow, snap.runs.select("*"), snap.states.select("*"), snap.tasks.select("*"))
    for start in (snap, plain):
        found = _plans(monkeypatch)
        got = state.fail_tasks(start, failures, now())
        # A row has some 290 bytes and 256 a task: 3.2 MB in all.
        parts = {int(n) for n in re.findall(r"hashpartitioning\(run_id#\d+, (\d+)\)", found[-1])}
        assert len(parts) == 1 and 20 < min(parts) < 60
        assert len(got.made[0].inputFiles()) >= min(parts)
        for a, b in ((got.states, want.states), (got.tasks, want.tasks), (got.runs, want.runs)):
            assert a.exceptAll(b).isEmpty() and a.count() == b.count()
    few = session.written(spark.range(2500).coalesce(1), "few")
    assert len(few.inputFiles()) == 3 and few.count() == 2500


def test_messages_are_counted_in_the_row_of_their_run(spark, finished):
    snap, _ = finished
    failed = state.fail_tasks(snap, frame(spark, [("0", "m", 0, "bad")], "error"), now())
    for one in (snap, failed):
        got = state.messages_by_step(one)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        want = one.tasks.groupBy("run_id", "step_slug").agg(F.count_if(F.col("archived_at").isNull()).alias("in_queue"))
        assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 3
        assert got.dtypes == want.dtypes


@pytest.mark.parametrize("name", ["state_fail_run", "state_fail_cascade", "state_fail_skip"])
def test_a_failing_query_joins_partitions_that_grow_with_its_rows(spark, monkeypatch, name):
    """Their count, not the size of each, follows the rows, so that no sort outgrows a task; results are the same."""
    from loomspark.plans import catalogue

    run = lambda: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = run()
    monkeypatch.setattr(state, "_PART_BYTES", 100_000, raising=False)
    found = _plans(monkeypatch)
    got = run()
    # 1500 rows of some 410 bytes and 6000 tasks of 256: 2.2 MB at least.
    parts = {int(n) for n in re.findall(r"hashpartitioning\(run_id#\d+, (\d+)\)", found[-1])}
    assert len(parts) == 1 and 20 < min(parts) < 40
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() == 4500
