import json

import pytest

from loomspark.plans.flow import Flow
from loomspark.streaming.runs import COMMANDS, fold_stream, run_stream

FLOW = (
    Flow("s", {"max_attempts": 2, "base_delay": 3})
    .step("items", None)
    .map("each", None, "items")
    .step("extra", None, ["items"], if_={"items": [99]})
    .step("sum", None, ["each", "extra"])
)


def commands(run, outputs, start=0):
    rows = [(run, start, "start", None, None, json.dumps({"go": 1}))]
    rows += [(run, start + 1 + k, c, s, i, json.dumps(o)) for k, (c, s, i, o) in enumerate(outputs)]
    return rows


@pytest.fixture(scope="module")
def stream_events(spark, tmp_path_factory):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = commands("a", [("complete", "items", 0, [1, 2]), ("complete", "each", 1, 20), ("complete", "each", 0, 10), ("complete", "sum", 0, 30)])
    rows += commands("b", [("complete", "items", 0, [])])
    rows += commands("c", [("complete", "items", 0, "not an array"), ("complete", "items", 0, [])])
    rows += commands("d", [("fail", "items", 0, "x"), ("fail", "items", 0, "y"), ("complete", "items", 0, [])])
    src, ck = (str(tmp_path_factory.mktemp(n)) for n in ("src", "ck"))
    spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(COMMANDS).parquet(src)
    q = run_stream(FLOW, stream).writeStream.format("memory").queryName("run_events").option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table("run_events")


def log(events, run):
    return [(r.event_type, r.step_slug) for r in events.filter(f"run_id = '{run}'").orderBy("seq").collect()]


def test_fan_out_and_ordered_gather(stream_events):
    got = log(stream_events, "a")
    assert got[-1] == ("run:completed", None) and ("step:skipped", "extra") in got
    each = stream_events.filter("run_id = 'a' and event_type = 'step:completed' and step_slug = 'each'").first()
    assert json.loads(each.payload) == [10, 20]
    end = stream_events.filter("run_id = 'a' and event_type = 'run:completed'").first()
    assert json.loads(end.payload) == {"sum": 30}


def test_empty_array_cascades(stream_events):
    each = stream_events.filter("run_id = 'b' and step_slug = 'each'").collect()
    assert [(r.event_type, r.payload) for r in each] == [("step:completed", "[]")]


def test_type_violation_and_late_report(stream_events):
    assert log(stream_events, "c")[-3:] == [("step:failed", "items"), ("run:failed", None), ("task:dropped", "items")]


def test_retry_then_failure(stream_events):
    got = log(stream_events, "d")
    assert ("task:retry", "items") in got and ("run:failed", None) in got and got[-1][0] == "task:dropped"


def test_fold(stream_events):
    got = {r.run_id: r.status for r in fold_stream(stream_events).collect()}
    assert got == {"a": "completed", "b": "started", "c": "failed", "d": "failed"}


def test_ticks_wait_requeue_and_give_up(spark, tmp_path):
    """With a clock, a failed task waits for its backoff and a silent one is queued again three times."""
    flow = Flow("t", {"max_attempts": 2, "base_delay": 3, "timeout": 5}).step("a", None)
    script = [("start", "{}"), ("tick", "0"), ("fail", '"x"'), ("complete", "1"), ("tick", "5"), ("tick", "6")] + [("tick", str(6 + 36 * k)) for k in range(1, 5)] + [("complete", "1")]
    rows = [("r", k, c, "a" if c in ("fail", "complete") else None, 0, p) for k, (c, p) in enumerate(script)]
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    spark.createDataFrame(rows, COMMANDS).coalesce(1).write.parquet(src)
    q = run_stream(flow, spark.readStream.schema(COMMANDS).parquet(src)).writeStream.format("memory").queryName("ticks").option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r.event_type for r in spark.table("ticks").orderBy("seq").collect()]
    assert got == ["run:started", "step:started", "task:retry", "task:dropped", "task:visible", "task:requeued", "task:requeued", "task:requeued", "task:stalled", "task:dropped"]


class _Store:
    """A state of the store, in memory, that counts the calls."""

    def __init__(self, calls):
        self.calls, self.value, self.cells = calls, None, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("exists", "get"):
                return self.value is not None if name == "exists" else self.value
            if name == "update":
                self.value = args[0]
            elif name == "clear":
                self.value, self.cells = None, {}
            elif name == "updateValue":
                self.cells[args[0]] = args[1]
            return {"containsKey": lambda k: k in self.cells, "getValue": lambda k: self.cells[k], "iterator": lambda: iter(list(self.cells.items()))}.get(name, lambda *_: None)(*args)

        return call


def _processor():
    from loomspark.streaming.runs import RunProcessor

    calls, stores = [], {}
    make = lambda name, *_: stores.setdefault(name, _Store(calls))
    runner = RunProcessor(Flow("n", {"max_attempts": 2, "base_delay": 3}).map("each", None).step("sum", None, ["each"]))
    runner.init(type("Handle", (), {"getValueState": staticmethod(make), "getMapState": staticmethod(make)}))
    return runner, calls, stores


def _feed(runner, rows):
    import pandas as pd

    names = [c.split()[0] for c in COMMANDS.split(", ")]
    found = [r for part in runner.handleInputRows(("r",), iter([pd.DataFrame(rows, columns=names)]), None) for r in part.itertuples(index=False)]
    return [tuple(r._replace(task_index=None if pd.isna(r.task_index) else int(r.task_index))) for r in found]


def test_a_batch_asks_the_store_once_a_cell():
    """The store is asked by batch, not by command, and a run that starts and ends in a batch leaves only its status."""
    n = 50
    rows = [("r", 0, "start", None, None, json.dumps(list(range(n))))] + [("r", 1 + k, "complete", "each", k, str(k)) for k in range(n)] + [("r", n + 1, "complete", "sum", 0, "1")]
    runner, calls, stores = _processor()
    assert _feed(runner, rows)[-1][2] == "run:completed"
    assert len(calls) <= 3 and json.loads(stores["run"].value[0]) == {"status": "completed", "input": None}
    assert [e[2] for e in _feed(runner, rows[1:2])] == ["task:dropped"]


def test_batches_of_any_size_give_the_same_events():
    """State that goes through the store between commands tells the same as state that is held."""
    script = [("start", None, None, "[5,6]"), ("tick", None, None, "0"), ("fail", "each", 0, '"x"'), ("tick", None, None, "20"), ("complete", "each", 1, "12"), ("complete", "each", 0, "10"), ("complete", "each", 0, "11"), ("complete", "sum", 0, "22"), ("start", None, None, "[1]"), ("complete", "sum", 0, "1")]
    rows, logs = [("r", k, *c) for k, c in enumerate(script)], []
    for size in (1, 3, len(rows)):
        runner, _, stores = _processor()
        logs.append([e for k in range(0, len(rows), size) for e in _feed(runner, rows[k : k + size])])
        assert stores["steps"].cells == {} and stores["tasks"].cells == {} and stores["clock"].value is None
    assert logs[0] == logs[1] == logs[2] and [e[2] for e in logs[0]].count("run:completed") == 1
    assert [e[2] for e in logs[0]].count("task:visible") == 1
