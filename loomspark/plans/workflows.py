"""Queries over the workflow views, part three: the state operators on real tables, definitions, events, monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import definitions, events, queue, state, workers
from loomspark.plans.flow import Flow
from loomspark.plans.relational import query
from loomspark.sources import fixtures as X

_NOW = "TIMESTAMP '2024-01-01 00:00:00'"


def _now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _us(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# -- the state operators over every order --------------------------------------------

#: A root map over a run's items, a sum of its outputs, and a report that needs the sum.
ITEMS = Flow("items", {"max_attempts": 2, "base_delay": 3}).map("each", None).step("sum", None, ["each"]).step("report", None, ["sum"])
_N = "(SELECT r.run_id, a.items, coalesce(len(a.items), 0) AS n FROM fx_runs r LEFT JOIN fx_arrays a ON a.run_id = r.run_id)"


def _started(spark: SparkSession, d: str, flow: Flow = ITEMS) -> state.Snapshot:
    inputs = X.run_arrays(spark, d).select("run_id", F.to_json("items").alias("input"))
    return state.start_runs(flow, inputs, _now())[0]


def _working(spark: SparkSession, d: str, flow: Flow = ITEMS) -> tuple[state.Snapshot, DataFrame]:
    """All queued tasks started: (snapshot, records)."""
    snap = _started(spark, d, flow)
    return state.start_tasks(snap, snap.tasks, "w1", _now())


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, 'each' AS step_slug, unnest(generate_series(0, n - 1)) AS task_index, 'queued' AS status FROM {_N} WHERE n > 0
    UNION ALL SELECT CAST(run_id AS VARCHAR), 'sum', 0, 'queued' FROM {_N} WHERE n = 0""",
    "fx_runs", "fx_arrays",
)
def state_start_runs(spark: SparkSession, d: str) -> DataFrame:
    """The tasks after starting a run for each order: one an item, and past an empty map the next step's."""
    return _started(spark, d).tasks.select("run_id", "step_slug", F.col("task_index").cast("long").alias("task_index"), "status")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, 'each' AS step_slug, CAST(i - 1 AS BIGINT) AS task_index, CAST(items[i] AS VARCHAR) AS input, NULL AS flow_input FROM (SELECT run_id, items, unnest(generate_series(1, n)) AS i FROM {_N})
    UNION ALL SELECT CAST(run_id AS VARCHAR), 'sum', 0, '{{"each":[]}}', NULL FROM {_N} WHERE n = 0""",
    "fx_runs", "fx_arrays",
)
def state_start_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The input of every task: its element for a map, the object of its parents' outputs for other steps."""
    _, records = _working(spark, d)
    return records.select("run_id", "step_slug", F.col("task_index").cast("long").alias("task_index"), "input", "flow_input")


def _doubled(records: DataFrame) -> DataFrame:
    """Outputs of the tasks: twice the element of ``each``, and for ``sum`` the text of its input."""
    twice = (F.col("input").cast("long") * 2).cast("string")
    return records.select("run_id", "step_slug", "task_index", F.when(F.col("step_slug") == "each", twice).otherwise('"none"').alias("output"))


@query(
    f"""WITH e AS (SELECT CAST(r.run_id AS VARCHAR) AS run_id, r.n, '[' || coalesce((SELECT string_agg(CAST(x * 2 AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(r.items) AS x, unnest(generate_series(1, r.n)) AS k)), '') || ']' AS output FROM {_N} r)
    SELECT run_id, 'each' AS step_slug, 'completed' AS status, output, 0 AS remaining_tasks, 0 AS remaining_deps FROM e
    UNION ALL SELECT run_id, 'sum', CASE WHEN n = 0 THEN 'completed' ELSE 'started' END, CASE WHEN n = 0 THEN '"none"' END, CASE WHEN n = 0 THEN 0 ELSE 1 END, 0 FROM e
    UNION ALL SELECT run_id, 'report', CASE WHEN n = 0 THEN 'started' ELSE 'created' END, NULL, CASE WHEN n = 0 THEN 1 END, CASE WHEN n = 0 THEN 0 ELSE 1 END FROM e""",
    "fx_runs", "fx_arrays",
)
def state_complete_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Step states after all started tasks completed: a map's outputs in task order, and the next step started."""
    snap, records = _working(spark, d)
    done = state.complete_tasks(snap, _doubled(records), _now())
    return done.states.select("run_id", "step_slug", "status", "output", "remaining_tasks", "remaining_deps")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, '{{"total":' || CAST(coalesce((SELECT sum(x) FROM (SELECT unnest(r.items) AS x)), 0) AS VARCHAR) || '}}' AS output, 'completed' AS status, 0 AS remaining_steps FROM {_N} r""",
    "fx_runs", "fx_arrays",
)
def state_whole_run(spark: SparkSession, d: str) -> DataFrame:
    """Runs carried to their end by starts and completions alone; the output is the object of the leaves."""
    flow = Flow("totals").map("each", None).step("total", None, ["each"])
    snap = _started(spark, d, flow)
    for _ in flow.waves():
        snap, records = state.start_tasks(snap, snap.tasks, "w1", _now())
        total = F.aggregate(F.from_json(F.try_variant_get(F.parse_json("input"), "$.each", "string"), "array<bigint>"), F.lit(0).cast("bigint"), lambda a, x: a + x)
        outputs = records.select("run_id", "step_slug", "task_index", F.when(F.col("step_slug") == "each", F.col("input")).otherwise(total.cast("string")).alias("output"))
        snap = state.complete_tasks(snap, outputs, _now())
    return snap.runs.select("run_id", "output", "status", "remaining_steps")


def _failing(spark: SparkSession, d: str, mode: str, attempts: int) -> state.Snapshot:
    """Every item over 40 fails once."""
    flow = Flow("modes", {"max_attempts": attempts, "base_delay": 3}).map("each", None, when_exhausted=mode).step("after", None, ["each"]).step("other", None)
    snap, records = _working(spark, d, flow)
    failures = records.filter("step_slug = 'each' and cast(input as bigint) > 40").select("run_id", "step_slug", "task_index", F.lit("too large").alias("error"))
    return state.fail_tasks(snap, failures, _now())


_BAD = "(SELECT CAST(run_id AS VARCHAR) AS run_id, n, n > 0 AND list_max(items) > 40 AS bad FROM " + _N + ")"


@query(
    f"""SELECT run_id, 'each' AS step_slug, CASE WHEN bad THEN 'failed' WHEN n = 0 THEN 'completed' ELSE 'started' END AS status, NULL AS skip_reason, CASE WHEN bad THEN 'too large' END AS error, CASE WHEN bad THEN 'failed' ELSE 'started' END AS run_status FROM {_BAD}
    UNION ALL SELECT run_id, 'after', CASE WHEN n = 0 THEN 'started' ELSE 'created' END, NULL, NULL, CASE WHEN bad THEN 'failed' ELSE 'started' END FROM {_BAD}
    UNION ALL SELECT run_id, 'other', 'started', NULL, NULL, CASE WHEN bad THEN 'failed' ELSE 'started' END FROM {_BAD}""",
    "fx_runs", "fx_arrays",
)
def state_fail_run(spark: SparkSession, d: str) -> DataFrame:
    """A spent task of a step in mode ``fail`` ends its run."""
    return state.states_of_runs(_failing(spark, d, "fail", 1)).select("run_id", "step_slug", "status", "skip_reason", "error", "run_status")


@query(
    f"""SELECT run_id, 'each' AS step_slug, CASE WHEN bad THEN 'skipped' WHEN n = 0 THEN 'completed' ELSE 'started' END AS status, CASE WHEN bad THEN 'handler_failed' END AS skip_reason FROM {_BAD}
    UNION ALL SELECT run_id, 'after', CASE WHEN n = 0 OR bad THEN 'started' ELSE 'created' END, NULL FROM {_BAD} UNION ALL SELECT run_id, 'other', 'started', NULL FROM {_BAD}""",
    "fx_runs", "fx_arrays",
)
def state_fail_skip(spark: SparkSession, d: str) -> DataFrame:
    """In mode ``skip`` the step is skipped and its child goes on without its output."""
    return _failing(spark, d, "skip", 1).states.select("run_id", "step_slug", "status", "skip_reason")


@query(
    f"""SELECT run_id, 'each' AS step_slug, CASE WHEN bad THEN 'skipped' WHEN n = 0 THEN 'completed' ELSE 'started' END AS status, CASE WHEN bad THEN 'handler_failed' END AS skip_reason FROM {_BAD}
    UNION ALL SELECT run_id, 'after', CASE WHEN bad THEN 'skipped' WHEN n = 0 THEN 'started' ELSE 'created' END, CASE WHEN bad THEN 'dependency_skipped' END FROM {_BAD} UNION ALL SELECT run_id, 'other', 'started', NULL FROM {_BAD}""",
    "fx_runs", "fx_arrays",
)
def state_fail_cascade(spark: SparkSession, d: str) -> DataFrame:
    """In mode ``skip-cascade`` all descendants are skipped too."""
    return _failing(spark, d, "skip-cascade", 1).states.select("run_id", "step_slug", "status", "skip_reason")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(i - 1 AS BIGINT) AS task_index, CASE WHEN items[i] > 40 THEN 'queued' ELSE 'started' END AS status,
    CAST(epoch_us({_NOW} + to_seconds(CASE WHEN items[i] > 40 THEN 6 ELSE 62 END)) AS BIGINT) AS visible_us, items[i] > 40 AS waits FROM (SELECT run_id, items, unnest(generate_series(1, n)) AS i FROM {_N})""",
    "fx_runs", "fx_arrays",
)
def state_retry(spark: SparkSession, d: str) -> DataFrame:
    """A failed task with attempts left is queued again after base * 2^attempts seconds; the others keep their lease."""
    tasks = _failing(spark, d, "fail", 3).tasks.filter("step_slug = 'each'")
    return tasks.select("run_id", F.col("task_index").cast("long").alias("task_index"), "status", _us("visible_at").alias("visible_us"), F.col("started_at").isNull().alias("waits"))


@query(
    f"""SELECT b.run_id, s.step_slug, CAST(CASE WHEN b.bad THEN 0 WHEN s.step_slug = 'each' THEN b.n ELSE 1 END AS BIGINT) AS in_queue FROM {_BAD} b
    JOIN (VALUES ('each'), ('after'), ('other')) AS s(step_slug) ON CASE s.step_slug WHEN 'each' THEN b.n > 0 WHEN 'after' THEN b.n = 0 ELSE true END""",
    "fx_runs", "fx_arrays",
)
def state_archived_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages still in the queue by step: a failed run's have all been archived."""
    return state.messages_by_step(_failing(spark, d, "fail", 1))


@query(f"SELECT queue_name, msg_id, read_ct, message FROM (SELECT 'items' AS queue_name, run_id || '/each/' || CAST(i AS VARCHAR) AS msg_id, 0 AS read_ct, '{{\"flow_slug\":\"items\",\"run_id\":\"' || run_id || '\",\"step_slug\":\"each\",\"task_index\":' || CAST(i AS VARCHAR) || '}}' AS message FROM (SELECT CAST(run_id AS VARCHAR) AS run_id, unnest(generate_series(0, n - 1)) AS i FROM {_N} WHERE n > 0) UNION ALL SELECT 'items', CAST(run_id AS VARCHAR) || '/sum/0', 0, '{{\"flow_slug\":\"items\",\"run_id\":\"' || CAST(run_id AS VARCHAR) || '\",\"step_slug\":\"sum\",\"task_index\":0}}' FROM {_N} WHERE n = 0)", "fx_runs", "fx_arrays")
def state_messages(spark: SparkSession, d: str) -> DataFrame:
    """The queue of a snapshot's open tasks."""
    return state.messages(_started(spark, d)).select("queue_name", "msg_id", "read_ct", "message")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, step_slug, CASE WHEN n > 3 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n > 3 THEN 'failed' ELSE 'started' END AS run_status FROM (SELECT run_id, n, 'load' AS step_slug FROM {_N})
    UNION ALL SELECT CAST(run_id AS VARCHAR), 'each', CASE WHEN n > 3 THEN 'created' WHEN n = 0 THEN 'completed' ELSE 'started' END, CASE WHEN n > 3 THEN 'failed' ELSE 'started' END FROM {_N}
    UNION ALL SELECT CAST(run_id AS VARCHAR), 'end', CASE WHEN n = 0 THEN 'started' ELSE 'created' END, CASE WHEN n > 3 THEN 'failed' ELSE 'started' END FROM {_N}""",
    "fx_runs", "fx_arrays",
)
def state_type_violation(spark: SparkSession, d: str) -> DataFrame:
    """A step that feeds a map fails its run with any output but an array."""
    flow = Flow("typed").step("load", None).map("each", None, "load").step("end", None, ["each"])
    snap, records = _working(spark, d, flow)
    n = F.json_array_length("input")
    output = F.when(n > 3, F.concat(F.lit('{"n":'), n.cast("string"), F.lit("}"))).otherwise(F.col("input"))
    done = state.complete_tasks(snap, records.select("run_id", "step_slug", "task_index", output.alias("output")), _now())
    return state.states_of_runs(done).select("run_id", "step_slug", "status", "run_status")


_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query(
    f"""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS run_id, {_K} AS k FROM events), f AS (SELECT run_id, k, k = 5 AS stops FROM e)
    SELECT run_id, 'a' AS step_slug, CASE WHEN stops THEN 'created' WHEN k = 3 THEN 'started' ELSE 'skipped' END AS status, CASE WHEN NOT stops AND k <> 3 THEN 'condition_unmet' END AS skip_reason FROM f
    UNION ALL SELECT run_id, 'b', CASE WHEN stops THEN 'created' WHEN k = 3 THEN 'created' ELSE 'skipped' END, CASE WHEN NOT stops AND k <> 3 THEN 'dependency_skipped' END FROM f
    UNION ALL SELECT run_id, 'c', CASE WHEN stops THEN 'created' WHEN k <> 4 THEN 'started' ELSE 'skipped' END, CASE WHEN NOT stops AND k = 4 THEN 'condition_unmet' END FROM f
    UNION ALL SELECT run_id, 'd', CASE WHEN k = 4 THEN 'started' ELSE 'created' END, NULL FROM f
    UNION ALL SELECT run_id, 'gate', CASE WHEN stops THEN 'failed' ELSE 'started' END, NULL FROM f"""
)
def state_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Conditions at the start of a run: skip with and without descendants, and one that fails the run before anything starts."""
    flow = (
        Flow("conditions").step("a", None, if_={"k": 3}, when_unmet="skip-cascade").step("b", None, ["a"])
        .step("c", None, if_not={"k": 4}).step("d", None, ["c"], if_not={"c": {}}).step("gate", None, if_not={"k": 5}, when_unmet="fail")
    )
    inputs = X.table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("props").alias("input"))
    return state.start_runs(flow, inputs, _now())[0].states.select("run_id", "step_slug", "status", "skip_reason")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, event_type, step_slug FROM (
    SELECT run_id, 'run:started' AS event_type, NULL AS step_slug FROM {_N} UNION ALL SELECT run_id, 'step:started', 'each' FROM {_N} WHERE n > 0
    UNION ALL SELECT run_id, 'step:completed', 'each' FROM {_N} WHERE n = 0 UNION ALL SELECT run_id, 'step:started', 'sum' FROM {_N} WHERE n = 0)""",
    "fx_runs", "fx_arrays",
)
def state_events(spark: SparkSession, d: str) -> DataFrame:
    """The events that the start of a run emits: an empty map completes without having started."""
    return _started(spark, d).events.select("run_id", "event_type", "step_slug")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, '{{"run_id":"' || CAST(run_id AS VARCHAR) || '","flow_slug":"items","status":"started","step_slug":"each","remaining_tasks":' || CAST(n AS VARCHAR) || ',"started_at":"2024-01-01T00:00:00.000Z"}}' AS payload FROM {_N} WHERE n > 0""",
    "fx_runs", "fx_arrays",
)
def state_event_payload(spark: SparkSession, d: str) -> DataFrame:
    """What the event of a started step tells its listeners."""
    return _started(spark, d).events.filter("event_type = 'step:started' and step_slug = 'each'").select("run_id", "payload")


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(i - 1 AS BIGINT) AS task_index, CASE WHEN items[i] > 40 THEN 'started' ELSE 'queued' END AS status, CAST(CASE WHEN items[i] > 40 THEN 3 ELSE 1 END AS INT) AS requeued_count, items[i] > 40 AS given_up
    FROM (SELECT run_id, items, unnest(generate_series(1, n)) AS i FROM {_N})""",
    "fx_runs", "fx_arrays",
)
def state_requeue(spark: SparkSession, d: str) -> DataFrame:
    """Stalled tasks of a snapshot: queued again without a worker, or given up and archived after three times."""
    snap, records = _working(spark, d)
    large = records.filter("step_slug = 'each' and cast(input as bigint) > 40").select("run_id", "step_slug", "task_index", F.lit(True).alias("large"))
    tasks = snap.tasks.join(large, ["run_id", "step_slug", "task_index"], "left").withColumn("requeued_count", F.when(F.col("large"), 3).otherwise(0)).drop("large")
    after = state.requeue(state.Snapshot(snap.flow, snap.runs, snap.states, tasks), F.lit("2024-01-01 01:00:00").cast("timestamp")).tasks.filter("step_slug = 'each'")
    return after.select("run_id", F.col("task_index").cast("long").alias("task_index"), "status", "requeued_count", (F.col("permanently_stalled_at").isNotNull() & F.col("archived_at").isNotNull()).alias("given_up"))


@query(
    f"""SELECT CAST(run_id AS VARCHAR) AS run_id, CASE WHEN n > 0 THEN '[{{"status":"started","step_slug":"each"}},{{"status":"created","step_slug":"report"}},{{"status":"created","step_slug":"sum"}}]'
    ELSE '[{{"status":"completed","step_slug":"each"}},{{"status":"created","step_slug":"report"}},{{"status":"started","step_slug":"sum"}}]' END AS steps FROM {_N}""",
    "fx_runs", "fx_arrays",
)
def start_with_states(spark: SparkSession, d: str) -> DataFrame:
    """Start and read back in one go: each run with the array of its step states."""
    snap = _started(spark, d)
    steps = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("step_slug", "status"))), lambda x: F.struct(x["status"].alias("status"), x["step_slug"].alias("step_slug"))))
    return snap.states.groupBy("run_id").agg(steps.alias("steps"))


# -- events --------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT run_id, step_slug, CASE status WHEN 'queued' THEN 'created' ELSE status END AS status, started_at AS moment FROM fx_tasks), s AS (SELECT run_id, step_slug, max(CASE WHEN moment < TIMESTAMP '1995-06-01 00:00:00' THEN moment END) AS seen FROM e GROUP BY 1, 2),
    l AS (SELECT e.run_id, e.step_slug, e.status FROM e JOIN s ON s.run_id = e.run_id AND s.step_slug = e.step_slug WHERE s.seen IS NULL OR e.moment > s.seen UNION ALL SELECT run_id, step_slug, 'started' FROM s WHERE seen IS NOT NULL)
    SELECT run_id, step_slug, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN bool_or(status = 'started') THEN 'started' ELSE 'created' END AS status FROM l GROUP BY 1, 2""",
    "fx_tasks",
)
def snapshot_then_events(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot taken at a moment, brought up to date by the events after it."""
    e = X.tasks(spark, d).select("run_id", "step_slug", F.when(F.col("status") == "queued", "created").otherwise(F.col("status")).alias("status"), F.col("started_at").alias("at"))
    moment = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    taken = e.filter(F.col("at") < moment).groupBy("run_id", "step_slug").agg(F.max("at").alias("at")).withColumn("status", F.lit("started"))
    return events.apply_events(taken, e, ["run_id", "step_slug"], events.STEP_RANK, events.STEP_TERMINAL)


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'object' ELSE 'string' END AS kind, CASE WHEN event_id % 2 = 0 THEN " + _K + " END AS k FROM events")
def payload_auto_parse(spark: SparkSession, d: str) -> DataFrame:
    """Payload text that is JSON becomes its value; other text stays a string."""
    e = X.table(spark, d, "events").withColumn("payload", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("plain "), "event_type")))
    p = events.parsed(e.select("event_id", "payload"), "payload")
    kind = F.when(F.startswith(F.schema_of_variant("payload"), F.lit("OBJECT")), "object").otherwise("string")
    return p.select("event_id", kind.alias("kind"), F.try_variant_get("payload", "$.k", "int").alias("k"))


@query(
    "SELECT event_id, event_type FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'run:started' WHEN event_id % 3 = 1 THEN 'step:completed' ELSE 'step:' || event_type END AS event_type FROM events) WHERE event_type IN ('run:started', 'step:completed')"
)
def event_guards(spark: SparkSession, d: str) -> DataFrame:
    """Only events whose type, status and slug belong together pass."""
    n = F.col("event_id") % 3
    e = X.table(spark, d, "events").select(
        "event_id", F.when(n == 0, "run:started").when(n == 1, "step:completed").otherwise(F.concat(F.lit("step:"), "event_type")).alias("event_type"),
        F.when(n == 0, "started").when(n == 1, "completed").otherwise(F.col("event_type")).alias("status"), F.when(n != 0, "a").alias("step_slug"),
    )
    return events.valid_events(e).select("event_id", "event_type")


@query(
    """SELECT event_id, seq, event_type, step_slug FROM (SELECT event_id, k, unnest([0, 1, 2, 3, 4]) AS s FROM (SELECT event_id, """ + _K + """ AS k FROM events)) e
    JOIN (VALUES (0, 'run:started', NULL, -1), (1, 'step:started', 'a', 0), (2, 'step:completed', 'a', 1), (3, '?', 'b', 2), (4, 'run:completed', NULL, 3)) AS v(s, t, step_slug, o) ON v.s = e.s,
    LATERAL (SELECT CASE WHEN e.s = 3 THEN 'step:skipped' ELSE v.t END AS event_type, CAST(e.s + 1 AS BIGINT) AS seq) x WHERE k <> 3
    UNION ALL SELECT event_id, CAST(s + 1 AS BIGINT), v.t, v.step_slug FROM (SELECT event_id, unnest([0, 1, 2, 3, 4, 5]) AS s FROM (SELECT event_id, """ + _K + """ AS k FROM events) WHERE k = 3) e
    JOIN (VALUES (0, 'run:started', NULL), (1, 'step:started', 'a'), (2, 'step:completed', 'a'), (3, 'step:started', 'b'), (4, 'step:completed', 'b'), (5, 'run:completed', NULL)) AS v(i, t, step_slug) ON v.i = e.s"""
)
def run_event_log(spark: SparkSession, d: str) -> DataFrame:
    """The ordered log of compiled runs."""
    from loomspark.plans.batch import run_batch, run_events

    k = F.try_variant_get(F.parse_json("props"), "$.k", "int")
    flow = Flow("log").step("a", lambda x: x.flow_input["k"]).step("b", lambda x: x.deps["a"], ["a"], if_={"a": 3})
    runs = X.table(spark, d, "events").select("event_id", F.struct(k.alias("k")).alias("input"))
    log = run_events(flow, run_batch(flow, runs, run_col="event_id"), "event_id")
    return events.event_order(log.withColumnRenamed("seq", "at"), ["event_id"], ["at"]).select("event_id", F.col("seq").cast("long").alias("seq"), "event_type", "step_slug")


# -- conditions on nested values -----------------------------------------------------

_DOC = """CASE event_id % 4 WHEN 0 THEN '{"u":{"k":' || CAST(k AS VARCHAR) || ',"tags":["x",' || CAST(k AS VARCHAR) || ']}}' WHEN 1 THEN '{"u":{"k":null}}' WHEN 2 THEN '{"u":[{"k":3},{"k":4}]}' ELSE '{}' END"""


@query(
    f"""SELECT event_id, event_id % 4 = 0 AND k = 3 AS object, event_id % 4 = 0 AND k = 3 AS in_array, event_id % 4 = 1 AS is_null, event_id % 4 = 2 AS in_objects, event_id % 4 <> 3 AS has_key, event_id % 4 < 2 AS is_object
    FROM (SELECT event_id, {_K} AS k FROM events)"""
)
def containment_nested(spark: SparkSession, d: str) -> DataFrame:
    """Containment in nested objects and arrays, of null, and the presence of a key whatever its value."""
    from loomspark.plans.containment import contains, has_key

    k, n = F.try_variant_get(F.parse_json("props"), "$.k", "int").cast("string"), F.col("event_id") % 4
    doc = (
        F.when(n == 0, F.concat(F.lit('{"u":{"k":'), k, F.lit(',"tags":["x",'), k, F.lit("]}}"))).when(n == 1, '{"u":{"k":null}}')
        .when(n == 2, '{"u":[{"k":3},{"k":4}]}').otherwise("{}")
    )
    e = X.table(spark, d, "events").select("event_id", F.parse_json(doc).alias("v"))
    kind = e.schema["v"].dataType
    tests = {"object": {"u": {"k": 3}}, "in_array": {"u": {"tags": [3, "x"]}}, "is_null": {"u": {"k": None}}, "in_objects": {"u": [{"k": 4}]}}
    found = [contains(F.col("v"), kind, p).alias(name) for name, p in tests.items()]
    return e.select("event_id", *found, has_key(F.col("v"), "u").alias("has_key"), contains(F.col("v"), kind, {"u": {}}).alias("is_object"))


# -- definitions ---------------------------------------------------------------------


def _definitions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A flow for each part: a root, a map with a condition, and a step whose mode the part's size decides."""
    parts = X.table(spark, d, "part").select(F.concat(F.lit("flow_"), F.col("p_partkey").cast("string")).alias("flow_slug"), "p_size", "p_partkey")
    flows = parts.select("flow_slug", F.lit(3).alias("opt_max_attempts"), F.lit(5).alias("opt_base_delay"), F.lit(60).alias("opt_timeout"))
    null = F.lit(None)
    rows = F.array(
        F.struct(F.lit("a").alias("step_slug"), F.lit("single").alias("step_type"), F.lit(0).alias("step_index"), F.lit(0).alias("deps_count"), null.cast("string").alias("required_input_pattern"), F.lit("skip").alias("when_unmet")),
        F.struct(F.lit("m").alias("step_slug"), F.lit("map").alias("step_type"), F.lit(1).alias("step_index"), F.lit(1).alias("deps_count"), F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}")).alias("required_input_pattern"), F.when(F.col("p_size") > 25, "fail").otherwise("skip").alias("when_unmet")),
        F.struct(F.lit("z").alias("step_slug"), F.lit("single").alias("step_type"), F.lit(2).alias("step_index"), F.lit(2).alias("deps_count"), null.cast("string").alias("required_input_pattern"), F.lit("skip").alias("when_unmet")),
    )
    long = parts.select("flow_slug", "p_size", F.explode(rows).alias("s")).select("flow_slug", "p_size", "s.*")
    none = {f"opt_{o}": null.cast("int") for o in ("base_delay", "timeout", "start_delay")}
    own = F.when((F.col("step_slug") == "z") & (F.col("p_size") > 40), 7).cast("int")
    steps = long.withColumns({**none, "opt_max_attempts": own, "forbidden_input_pattern": null.cast("string"), "when_exhausted": F.lit("fail")}).select(*[c.split()[0] for c in definitions.STEPS.split(", ")])
    deps = parts.select("flow_slug", F.explode(F.array(*[F.struct(F.lit(a).alias("dep_slug"), F.lit(b).alias("step_slug")) for a, b in (("a", "m"), ("m", "z"), ("a", "z"))])).alias("e")).select("flow_slug", "e.*")
    return flows, steps, deps


def _shape_sql(size: str = "p_size") -> str:
    plain = lambda slug, kind, deps: f'{{"slug":"{slug}","stepType":"{kind}","dependencies":[{deps}],"whenUnmet":"skip","whenExhausted":"fail","requiredInputPattern":{{"defined":false}},"forbiddenInputPattern":{{"defined":false}}}}'
    middle = f"""'{{"slug":"m","stepType":"map","dependencies":["a"],"whenUnmet":"' || CASE WHEN {size} > 25 THEN 'fail' ELSE 'skip' END || '","whenExhausted":"fail","requiredInputPattern":{{"defined":true,"value":{{"size":' || CAST({size} AS VARCHAR) || '}}}},"forbiddenInputPattern":{{"defined":false}}}}'"""
    return f"""'{{"steps":[' || '{plain("a", "single", "")},' || {middle} || ',{plain("z", "single", '"a","m"')}]}}'"""


@query(f"SELECT 'flow_' || CAST(p_partkey AS VARCHAR) AS flow_slug, {_shape_sql()} AS shape FROM part")
def flow_shape_full(spark: SparkSession, d: str) -> DataFrame:
    """The shape of each flow from its definition tables, with modes and conditions."""
    _, steps, deps = _definitions(spark, d)
    return definitions.shape_json(steps, deps)


@query(f"SELECT 'flow_' || CAST(p_partkey AS VARCHAR) AS flow_slug, {_shape_sql()} AS shape FROM part")
def flow_from_shape(spark: SparkSession, d: str) -> DataFrame:
    """Shapes made into tables and read back as shapes: nothing is lost."""
    _, steps, deps = _definitions(spark, d)
    _, again, edges = definitions.from_shapes(definitions.shape_json(steps, deps))
    return definitions.shape_json(again, edges)


@query(
    """SELECT 'flow_' || CAST(p_partkey AS VARCHAR) AS flow_slug, step_index, field FROM part, (VALUES (1, 'stepType', 3), (1, 'requiredInputPattern', 5), (2, 'slug', 7)) AS v(step_index, field, every) WHERE p_partkey % every = 0"""
)
def shape_diff_fields(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two tables of shapes, field by field and by place."""
    _, steps, deps = _definitions(spark, d)
    key = F.regexp_extract("flow_slug", "([0-9]+)$", 1).cast("long")
    changed = steps.withColumns(
        {"step_type": F.when((F.col("step_index") == 1) & (key % 3 == 0), "single").otherwise(F.col("step_type")), "required_input_pattern": F.when(~((F.col("step_index") == 1) & (key % 5 == 0)), F.col("required_input_pattern"))}
    ).filter(~((F.col("step_index") == 2) & (key % 7 == 0)))
    found = definitions.field_differences(definitions.shape_json(steps, deps), definitions.shape_json(changed, deps))
    return found.select("flow_slug", F.col("step_index").cast("int").alias("step_index"), "field")


@query("SELECT 'flow_' || CAST(p_partkey AS VARCHAR) AS flow_slug, s AS step_slug, CAST(CASE WHEN s = 'z' AND p_size > 40 THEN 7 WHEN p_size > 10 THEN 9 ELSE 3 END AS INT) AS max_attempts, 5 AS base_delay, 60 AS timeout, 0 AS start_delay FROM part, (VALUES ('a'), ('m'), ('z')) AS v(s)")
def tuned_options(spark: SparkSession, d: str) -> DataFrame:
    """Options changed in the tables count at once; a step's own option beats its flow's."""
    flows, steps, _ = _definitions(spark, d)
    large = X.table(spark, d, "part").filter("p_size > 10").select(F.concat(F.lit("flow_"), F.col("p_partkey").cast("string")).alias("flow_slug"), F.lit(True).alias("large"))
    tuned = definitions.tune(flows.join(large, "flow_slug", "left"), F.coalesce("large", F.lit(False)), max_attempts=9).drop("large")
    return definitions.effective_options(tuned, steps)


@query("SELECT 'flow_' || CAST(p_partkey AS VARCHAR) AS flow_slug, step_index, s AS step_slug FROM part, (VALUES (0, 'a'), (1, 'm'), (2, 'z')) AS v(step_index, s) WHERE p_partkey = (SELECT min(p_partkey) FROM part)")
def read_definition(spark: SparkSession, d: str) -> DataFrame:
    """One flow with its steps in order."""
    flows, steps, _ = _definitions(spark, d)
    slug = "flow_" + str(X.table(spark, d, "part").agg(F.min("p_partkey")).first()[0])
    found = definitions.read_definition(flows, steps, slug)
    rows = F.explode(F.from_json("steps", "array<struct<step_index:int,step_slug:string>>")).alias("s")
    return found.select("flow_slug", rows).select("flow_slug", "s.step_index", "s.step_slug")


# -- queues and workers ----------------------------------------------------------------


@query("SELECT queue_name, count(*) AS n FROM fx_msgs WHERE queue_name <> 'q_err' GROUP BY queue_name UNION ALL SELECT 'q_new', 0", "fx_msgs")
def queue_create_drop(spark: SparkSession, d: str) -> DataFrame:
    """A queue created twice is there once; a dropped one takes its messages along."""
    messages = X.messages(spark, d)
    queues = messages.select("queue_name", F.lit(None).cast("timestamp").alias("created_at")).distinct()
    queues = queue.create_queue(queue.create_queue(queues, "q_new", _now()), "q_new", _now())
    queues, left = queue.drop_queue(queues, messages, "q_err")
    n = left.groupBy("queue_name").agg(F.count(F.lit(1)).alias("n"))
    return queues.select("queue_name").join(n, "queue_name", "left").select("queue_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT msg_id, CAST(epoch_us(enqueued_at + to_seconds(CAST(msg_id % 5 AS INT))) AS BIGINT) AS vt_us FROM fx_msgs", "fx_msgs")
def enqueue_delay(spark: SparkSession, d: str) -> DataFrame:
    """A batch sent with a delay of its own for each message."""
    m = X.messages(spark, d)
    empty = m.select("queue_name", "msg_id", "read_ct", "enqueued_at", F.col("enqueued_at").alias("vt"), "message").limit(0)
    sent = queue.send_batch(empty, m.select("queue_name", "msg_id", "message", "enqueued_at"), F.col("enqueued_at"), (F.col("msg_id") % 5).cast("int"))
    return sent.select("msg_id", _us("vt").alias("vt_us"))


@query(
    "SELECT 'w' || CAST(user_id AS VARCHAR) AS worker_id, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, user_id % 3 = 0 AS is_deprecated FROM events GROUP BY user_id"
)
def worker_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """Workers inserted, some of them deprecated, and beats that move their last one and tell them so."""
    beats = X.table(spark, d, "events").select(F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"), F.col("ts").alias("at"), "user_id")
    null = F.lit(None).cast("timestamp_ntz")
    known = beats.select("worker_id", "user_id").distinct().select("worker_id", F.when(F.col("user_id") % 3 == 0, "old").otherwise("new").alias("function_name"), null.alias("last_heartbeat_at"), null.alias("deprecated_at"), null.alias("stopped_at"))
    moved, answers = workers.beat(workers.deprecate(known, "old", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")), beats.select("worker_id", "at"))
    return moved.select("worker_id", _us("last_heartbeat_at").alias("last_us")).join(answers, "worker_id")


# -- monitoring ------------------------------------------------------------------------


@query("SELECT step_slug, count(*) AS tasks, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(max(attempts_count) AS BIGINT) AS attempts FROM fx_tasks WHERE run_id = (SELECT min(run_id) FROM fx_tasks) GROUP BY step_slug", "fx_tasks")
def run_step_details(spark: SparkSession, d: str) -> DataFrame:
    """What each step of one run has done."""
    tasks = X.tasks(spark, d)
    one = tasks.agg(F.min("run_id").alias("run_id"))
    mine = tasks.join(F.broadcast(one), "run_id")  # one row
    return mine.groupBy("step_slug").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.max("attempts_count").cast("long").alias("attempts"))


@query(f"SELECT CAST(run_id AS VARCHAR) AS run_id, 'each' AS step_slug, '[]' AS output FROM {_N} WHERE n = 0", "fx_runs", "fx_arrays")
def step_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The outputs that the steps of all runs have given so far."""
    return _started(spark, d).states.filter("status = 'completed'").select("run_id", "step_slug", "output")


@query(
    """SELECT round(max(mean) / min(mean), 4) AS time_ratio, CAST(max(size) AS DOUBLE) / min(size) AS size_ratio, max(mean) / min(mean) <= 1.5 * (CAST(max(size) AS DOUBLE) / min(size)) AS linear
    FROM (SELECT 1 + event_id % 3 AS size, avg(value) AS mean FROM events GROUP BY 1)"""
)
def linearity_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether times grow no faster than sizes, up to half as much again."""
    by = X.table(spark, d, "events").groupBy((1 + F.col("event_id") % 3).alias("size")).agg(F.avg("value").alias("mean"))
    time, size = F.max("mean") / F.min("mean"), F.max("size").cast("double") / F.min("size")
    return by.agg(F.round(time, 4).alias("time_ratio"), size.alias("size_ratio"), (time <= 1.5 * size).alias("linear"))


@query(
    """SELECT hour, coalesce(n, 0) AS n, n IS NULL AS gap FROM (SELECT unnest(generate_series((SELECT CAST(floor(epoch_us(min(ts)) / 3600000000) AS BIGINT) FROM events), (SELECT CAST(floor(epoch_us(max(ts)) / 3600000000) AS BIGINT) FROM events))) AS hour) h
    LEFT JOIN (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) e USING (hour)"""
)
def distribution_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Errors an hour over the whole span of time; an hour without any is a row too."""
    e = X.table(spark, d, "events").withColumn("hour", F.floor(_us("ts") / 3600000000).cast("long"))
    span = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b")).select(F.explode(F.sequence("a", "b")).alias("hour"))
    n = e.filter("event_type = 'error'").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    return span.join(n, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("gap"))


@query("SELECT round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events")
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles with the least and the greatest value, from a sort by ranges."""
    from loomspark.functions.quantiles import exact_quantiles

    points, names = [0.5, 0.75, 0.9, 0.95, 0.99, 0.0, 1.0], ["p50", "p75", "p90", "p95", "p99", "least", "most"]
    found = exact_quantiles(X.table(spark, d, "events"), "value", points, names)
    return found.select(*[F.round(n, 4).alias(n) for n in names])


@query(
    """SELECT r.run_id, t.step_slug, t.task_index, t.attempts_count, 'attempt ' || CAST(t.attempts_count AS VARCHAR) || ' of ' || t.status AS error FROM fx_runs r JOIN fx_tasks t ON t.run_id = r.run_id WHERE r.status = 'failed' AND t.status = 'started'""",
    "fx_runs", "fx_tasks",
)
def failed_run_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What was running in runs that failed, with the text a reader looks for."""
    failed = X.runs(spark, d).filter("status = 'failed'").select("run_id")
    text = F.format_string("attempt %d of %s", F.col("attempts_count").cast("int"), F.col("status"))
    return X.tasks(spark, d).filter("status = 'started'").join(failed, "run_id").select("run_id", "step_slug", "task_index", "attempts_count", text.alias("error"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS run_id, 'completed' AS status, '{"sum": ' || CAST(count(*) AS VARCHAR) || '}' AS output FROM conversations GROUP BY conv_id""")
def stream_vs_batch(spark: SparkSession, d: str) -> DataFrame:
    """The keyed processor of the stream, a run for each conversation and a task for each of its turns: runs end as a batch says."""
    from loomspark.operators.events import RUN_RANK, RUN_TERMINAL, fold_status
    from loomspark.streaming.runs import replay

    flow = Flow("stream").map("each", None).step("sum", None, ["each"])
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("size"))))
    runs = X.table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("run_id")).agg(F.transform(turns, lambda x: x["size"]).alias("items"))
    runs = runs.withColumn("n", F.size("items"))
    none = lambda kind: F.lit(None).cast(kind)
    command = lambda seq, name, step, index, payload: F.struct(seq.cast("bigint").alias("seq"), F.lit(name).alias("command"), F.lit(step).cast("string").alias("step_slug"), index.cast("int").alias("task_index"), payload.alias("payload"))
    start = command(F.lit(0), "start", None, none("int"), F.to_json("items"))
    items = F.transform("items", lambda x, k: command(k + 1, "complete", "each", k, (x * 2).cast("string")))
    last = command(F.col("n") + 1, "complete", "sum", F.lit(0), F.col("n").cast("string"))
    commands = runs.select("run_id", F.explode(F.concat(F.array(start), items, F.array(last))).alias("c")).select("run_id", "c.*")
    ends = replay(flow, commands).filter(F.startswith("event_type", F.lit("run:"))).select("run_id", "seq", "status", "payload")
    status = fold_status(ends, ["run_id"], RUN_RANK, RUN_TERMINAL, ["seq"]).select("run_id", "status")
    outputs = ends.filter("status = 'completed'").groupBy("run_id").agg(F.max("payload").alias("output"))
    return status.join(outputs.hint("merge"), "run_id")  # not through the driver: there are as many as runs
