"""The batch compiler against the simulator on random graphs, and its single rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.plans.batch import Outcome, PythonHandler, run_batch, run_events, step_states
from loomspark.plans.flow import Flow

from sim import simulate

MODES = ("fail", "skip", "skip-cascade")


def random_flow(seed):
    """Steps add up what they see; a step whose sum is divisible by its own prime fails."""
    r = random.Random(seed)
    flow, plain = Flow(f"f{seed}", {"max_attempts": 1}), {}
    for k in range(r.randint(3, 6)):
        slug = f"s{k}"
        deps = r.sample([s.slug for s in flow.steps], r.randint(0, min(2, k)))
        prime = r.choice([3, 5, 1000])
        pattern = {}
        if r.random() < 0.4:
            pattern[r.choice(["if_", "if_not"])] = {r.choice(deps): r.randint(0, 6)} if deps else {"a": r.randint(0, 2)}

        def column(x, deps=tuple(deps), k=k, prime=prime):
            total = F.lit(k)
            for d in deps:
                total = total + F.coalesce(x.deps[d], F.lit(0))
            total = total if deps else total + x.flow_input["a"]
            return Outcome(total % 7, total % prime != 0, "divisible")

        def value(given, deps=tuple(deps), k=k, prime=prime):
            total = k + (sum(given.get(d) or 0 for d in deps) if deps else given["a"])
            if total % prime == 0:
                raise ValueError("divisible")
            return total % 7

        flow = flow.step(slug, column, deps, when_unmet=r.choice(MODES), when_exhausted=r.choice(MODES), **pattern)
        plain[slug] = value
    return flow, plain


@pytest.mark.parametrize("seed", range(12))
def test_random_flows_equal_simulator(spark, seed):
    flow, plain = random_flow(seed)
    inputs = [{"a": a} for a in range(8)]
    runs = spark.createDataFrame([(k, (x["a"],)) for k, x in enumerate(inputs)], "run_id int, input struct<a:int>")
    done = run_batch(flow, runs).collect()
    for row in done:
        states, status, output = simulate(flow, inputs[row.run_id], plain)
        assert row.run_status == status
        assert {s.slug: (row[s.slug].status, row[s.slug].output, row[s.slug].skip_reason) for s in flow.steps} == {k: (v["status"], v["output"], v["reason"]) for k, v in states.items()}
        assert (json.loads(row.run_output) if row.run_output else None) == output


def test_map_failures_and_python_handlers(spark):
    def handler(x, context):
        if x == 3 and context["attempt"] < 2:
            raise ValueError("once")
        if x > 90:
            raise ValueError("too large")
        return x * 10

    flow = Flow("m", {"max_attempts": 2}).map("each", PythonHandler(handler, "bigint"), when_exhausted="skip").map("next", lambda x: x.item + 1, "each").step("n", lambda x: F.size(x.deps["next"]), ["next"])
    runs = spark.createDataFrame([(1, [1, 3]), (2, []), (3, [5, 99])], "run_id int, input array<bigint>")
    got = {r.run_id: r for r in run_batch(flow, runs).collect()}
    assert (got[1]["each"].output, got[1]["each"].attempts, got[1]["next"].output) == ([10, 30], 2, [11, 31])
    assert (got[2]["each"].output, got[2]["n"].output) == ([], 0)
    assert (got[3]["each"].status, got[3]["each"].skip_reason, got[3]["each"].error, got[3]["next"].output) == ("skipped", "handler_failed", "too large", [])


def test_type_violation_and_states_and_events(spark):
    flow = Flow("v").step("list", lambda x: F.when(x.flow_input > 0, F.array(x.flow_input)), when_exhausted="skip").map("each", lambda x: x.item, "list")
    done = run_batch(flow, spark.createDataFrame([(1, 1), (2, -1)], "run_id int, input int"))
    rows = {(r.run_id, r.step_slug): r for r in step_states(flow, done).collect()}
    assert rows[2, "list"].status == "failed" and rows[2, "list"].error.startswith("[TYPE_VIOLATION]") and rows[2, "each"].status == "created"
    assert rows[1, "each"].output == "[1]"
    log = [r.event_type for r in run_events(flow, done).filter("run_id = 1").orderBy("seq").collect()]
    assert log == ["run:started", "step:started", "step:completed", "step:started", "step:completed", "run:completed"]


def test_map_columns_need_no_shuffle_and_no_python(spark):
    flow = Flow("plain").map("a", lambda x: x.item + 1).map("b", lambda x: x.item * 2, "a")
    plan = run_batch(flow, spark.createDataFrame([(1, [1])], "run_id int, input array<bigint>"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_root_map_needs_array(spark):
    with pytest.raises(ValueError):
        run_batch(Flow("x").map("m", lambda x: x.item), spark.createDataFrame([(1, 1)], "run_id int, input int"))
