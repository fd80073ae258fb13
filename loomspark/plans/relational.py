"""Queries over the workflow views, part one: tasks, gathers, graph, conditions, retries, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.operators import graph, queue
from loomspark.sources import fixtures as X

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, *views: str):
    """Register the function under its name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = X.with_views(sql, *views) if views else sql
        return f

    return add


# -- fan-out and fan-in ------------------------------------------------------------


@query("SELECT run_id, CAST(i - 1 AS INT) AS task_index, items[i] AS item FROM (SELECT run_id, items, unnest(generate_series(1, len(items))) AS i FROM fx_arrays)", "fx_arrays")
def map_fanout_tasks(spark: SparkSession, d: str) -> DataFrame:
    """One task per array element; an empty array has none."""
    return X.arrays(spark, d).select("run_id", F.posexplode("items").alias("task_index", "item"))


@query("SELECT run_id, step_slug, '[' || string_agg(CAST(output AS VARCHAR), ',' ORDER BY task_index) || ']' AS output, count(*) AS n FROM fx_tasks GROUP BY run_id, step_slug", "fx_tasks")
def map_fanin_ordered(spark: SparkSession, d: str) -> DataFrame:
    """A map's outputs gathered in task order, whatever order they finished in."""
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("task_index", "output"))), lambda x: x["output"])
    return X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.to_json(gathered).alias("output"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT r.run_id, coalesce(t.output, '[]') AS output, CASE WHEN t.output IS NULL THEN 0 ELSE 1 END AS has_tasks FROM fx_runs r LEFT JOIN
    (SELECT run_id, '[' || string_agg(CAST(output AS VARCHAR), ',' ORDER BY step_slug, task_index) || ']' AS output FROM fx_tasks GROUP BY run_id) t ON r.run_id = t.run_id""",
    "fx_runs", "fx_tasks",
)
def map_empty_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Runs without tasks complete with an empty array and no task."""
    outputs = F.transform(F.array_sort(F.collect_list(F.struct("step_slug", "task_index", "output"))), lambda x: x["output"])
    done = X.tasks(spark, d).groupBy("run_id").agg(F.to_json(outputs).alias("output"))
    return X.runs(spark, d).select("run_id").join(done, "run_id", "left").select("run_id", F.coalesce("output", F.lit("[]")).alias("output"), F.when(F.col("output").isNull(), 0).otherwise(1).alias("has_tasks"))


@query(
    """SELECT r.run_id, count(a.x) AS n, CAST(coalesce(sum(a.x * a.x), 0) AS BIGINT) AS total, max(a.x * a.x) AS largest, min(a.x * a.x) AS smallest
    FROM fx_runs r LEFT JOIN (SELECT run_id, unnest(items) AS x FROM fx_arrays) a ON r.run_id = a.run_id GROUP BY r.run_id""",
    "fx_runs", "fx_arrays",
)
def map_chain_square_stats(spark: SparkSession, d: str) -> DataFrame:
    """Root map over a run's array, then one step that sums up; built with the flow compiler."""
    from loomspark.plans.batch import run_batch
    from loomspark.plans.flow import Flow

    flow = (
        Flow("square_stats")
        .map("squares", lambda x: x.item * x.item)
        .step("stats", lambda x: F.struct(F.size(x.deps["squares"]).cast("long").alias("n"), F.aggregate(x.deps["squares"], F.lit(0).cast("bigint"), lambda s, v: s + v).alias("total"), F.array_max(x.deps["squares"]).alias("largest"), F.array_min(x.deps["squares"]).alias("smallest")), depends_on=["squares"])
    )
    done = run_batch(flow, X.run_arrays(spark, d), input_col="items")
    return done.select("run_id", "stats.output.*")


@query("SELECT run_id, items[1] AS first_item, items[len(items)] AS last_item, items[3] AS third_item FROM fx_arrays", "fx_arrays")
def map_element_extract(spark: SparkSession, d: str) -> DataFrame:
    """A task takes its own element instead of the array; a place past the end is null."""
    return X.arrays(spark, d).select("run_id", F.get("items", F.lit(0)).alias("first_item"), F.element_at("items", -1).alias("last_item"), F.get("items", F.lit(2)).alias("third_item"))


@query(
    """SELECT run_id, '{' || string_agg('"' || step_slug || '":' || CAST(total AS VARCHAR), ',' ORDER BY step_slug) || '}' AS input FROM
    (SELECT run_id, step_slug, sum(output) AS total FROM fx_tasks GROUP BY run_id, step_slug) GROUP BY run_id""",
    "fx_tasks",
)
def deps_object_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The input of a dependent step: an object of its dependencies' outputs."""
    totals = X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.sum("output").alias("total"))
    pairs = F.array_sort(F.collect_list(F.struct("step_slug", "total")))
    return totals.groupBy("run_id").agg(F.to_json(F.map_from_entries(pairs)).alias("input"))


@query(
    """SELECT run_id, '{' || coalesce(string_agg('"' || step_slug || '":' || CAST(total AS VARCHAR), ',' ORDER BY step_slug) FILTER (done), '') || '}' AS input FROM
    (SELECT run_id, step_slug, sum(output) AS total, bool_and(status = 'completed') AS done FROM fx_tasks GROUP BY run_id, step_slug) GROUP BY run_id""",
    "fx_tasks",
)
def dep_skip_key_omitted(spark: SparkSession, d: str) -> DataFrame:
    """A dependency that did not complete has no key in the input, not a null."""
    per = X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.sum("output").alias("total"), F.bool_and(F.col("status") == "completed").alias("done"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("done"), F.struct("step_slug", "total"))))
    return per.groupBy("run_id").agg(F.to_json(F.map_from_entries(pairs)).alias("input"))


# -- graph -------------------------------------------------------------------------


@query("SELECT DISTINCT step_slug FROM fx_deps d WHERE NOT EXISTS (SELECT 1 FROM fx_deps e WHERE e.dep_slug = d.step_slug)", "fx_deps")
def leaf_steps(spark: SparkSession, d: str) -> DataFrame:
    return graph.leaves(X.deps(spark))


@query(
    """SELECT r.run_id, '{' || string_agg('"' || t.step_slug || '":' || CAST(t.total AS VARCHAR), ',' ORDER BY t.step_slug) || '}' AS output FROM fx_runs r JOIN
    (SELECT run_id, step_slug, sum(output) AS total FROM fx_tasks GROUP BY run_id, step_slug HAVING bool_and(status = 'completed')) t ON r.run_id = t.run_id
    WHERE NOT EXISTS (SELECT 1 FROM fx_deps e WHERE e.dep_slug = t.step_slug AND e.step_slug NOT IN ('leaf1', 'leaf2')) AND r.status = 'completed' GROUP BY r.run_id""",
    "fx_runs", "fx_tasks", "fx_deps",
)
def run_output_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Output of completed runs: an object of their completed leaf steps."""
    inner = X.deps(spark).filter(~F.col("step_slug").isin("leaf1", "leaf2")).select(F.col("dep_slug").alias("step_slug"))
    done = X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.sum("output").alias("total"), F.bool_and(F.col("status") == "completed").alias("done"))
    kept = done.filter("done").join(F.broadcast(inner), "step_slug", "left_anti").join(X.runs(spark, d).filter("status = 'completed'").select("run_id"), "run_id")
    return kept.groupBy("run_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step_slug", "total"))))).alias("output"))


_CLOSURE = """WITH RECURSIVE walk AS (SELECT dep_slug AS ancestor, step_slug, 1 AS depth FROM fx_deps UNION ALL
    SELECT w.ancestor, e.step_slug, w.depth + 1 FROM walk w JOIN fx_deps e ON e.dep_slug = w.step_slug) """


@query(_CLOSURE + "SELECT ancestor, step_slug, min(depth) AS depth FROM walk GROUP BY ancestor, step_slug", "fx_deps")
def descendants_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(X.deps(spark))


@query(
    _CLOSURE
    + """, trig AS (SELECT run_id, min(step_slug) AS step_slug FROM fx_tasks WHERE status = 'queued' AND step_slug IN ('step_r', 'step_a') GROUP BY run_id),
    hit AS (SELECT run_id, step_slug, 'condition_unmet' AS skip_reason FROM trig UNION ALL SELECT DISTINCT t.run_id, w.step_slug, 'dependency_skipped' FROM trig t JOIN walk w ON w.ancestor = t.step_slug)
    SELECT run_id, step_slug, skip_reason FROM hit""",
    "fx_deps", "fx_tasks",
)
def skip_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A skipped step with cascade takes all its descendants along."""
    trigger = X.tasks(spark, d).filter("status = 'queued' and step_slug in ('step_r', 'step_a')").groupBy("run_id").agg(F.min("step_slug").alias("step_slug"))
    below = graph.descendants(X.deps(spark)).select(F.col("ancestor").alias("trigger"), F.col("step_slug").alias("below"))
    hit = trigger.join(F.broadcast(below), F.col("step_slug") == F.col("trigger")).select("run_id", F.col("below").alias("step_slug"), F.lit("dependency_skipped").alias("skip_reason"))
    return trigger.withColumn("skip_reason", F.lit("condition_unmet")).unionByName(hit)


@query(
    _CLOSURE + "SELECT s.step_slug, CAST(coalesce(max(w.depth), 0) AS INT) AS wave FROM (SELECT dep_slug AS step_slug FROM fx_deps UNION SELECT step_slug FROM fx_deps) s LEFT JOIN walk w ON w.step_slug = s.step_slug GROUP BY s.step_slug",
    "fx_deps",
)
def topological_wave(spark: SparkSession, d: str) -> DataFrame:
    return graph.waves(X.deps(spark))


_STEP_DONE = "st AS (SELECT run_id, step_slug, bool_and(status = 'completed') AS done FROM fx_tasks GROUP BY run_id, step_slug)"


def _step_states(spark: SparkSession, d: str) -> DataFrame:
    return X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.bool_and(F.col("status") == "completed").alias("done"))


@query(
    f"WITH {_STEP_DONE} SELECT s.run_id, e.step_slug, CAST(count(*) FILTER (NOT s.done) AS BIGINT) AS remaining_deps FROM st s JOIN fx_deps e ON e.dep_slug = s.step_slug GROUP BY s.run_id, e.step_slug",
    "fx_tasks", "fx_deps",
)
def remaining_deps(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies that a step still waits for."""
    edges = X.deps(spark).select("dep_slug", F.col("step_slug").alias("child"))
    joined = _step_states(spark, d).join(F.broadcast(edges), F.col("step_slug") == F.col("dep_slug"))
    return joined.groupBy("run_id", F.col("child").alias("step_slug")).agg(F.count_if(~F.col("done")).alias("remaining_deps"))


@query(
    f"WITH {_STEP_DONE} SELECT s.run_id, e.step_slug FROM st s JOIN fx_deps e ON e.dep_slug = s.step_slug GROUP BY s.run_id, e.step_slug HAVING bool_and(s.done)",
    "fx_tasks", "fx_deps",
)
def ready_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps whose known dependencies have all completed."""
    return remaining_deps(spark, d).filter("remaining_deps = 0").select("run_id", "step_slug")


@query(
    "SELECT run_id, step_slug, count(*) AS initial_tasks, CAST(count(*) FILTER (status <> 'completed') AS BIGINT) AS remaining_tasks FROM fx_tasks GROUP BY run_id, step_slug",
    "fx_tasks",
)
def complete_countdown(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that a step was started with and those still open."""
    return X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.count(F.lit(1)).alias("initial_tasks"), F.count_if(F.col("status") != "completed").alias("remaining_tasks"))


# -- conditions --------------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS INT)"


def _when(spark: SparkSession, d: str, required: dict | None, forbidden: dict | None) -> DataFrame:
    from loomspark.plans.containment import condition_met

    events = X.table(spark, d, "events").withColumn("input", F.parse_json("props"))
    return events.select("event_id", condition_met(F.col("input"), events.schema["input"].dataType, required, forbidden).alias("met"))


@query(f"SELECT event_id, coalesce({_K} = 3, false) AS met FROM events")
def condition_if(spark: SparkSession, d: str) -> DataFrame:
    return _when(spark, d, {"k": 3}, None)


@query(f"SELECT event_id, coalesce({_K} <> 3, true) AS met FROM events")
def condition_ifnot(spark: SparkSession, d: str) -> DataFrame:
    return _when(spark, d, None, {"k": 3})


@query(f"SELECT event_id, {_K} IS NOT NULL AND {_K} <> 3 AS met FROM events")
def condition_if_and_ifnot(spark: SparkSession, d: str) -> DataFrame:
    return _when(spark, d, {}, {"k": 3})


@query(
    "SELECT run_id, CASE WHEN total IS NULL THEN 'fallback' ELSE 'main' END AS branch FROM (SELECT r.run_id, t.total FROM fx_runs r LEFT JOIN (SELECT run_id, sum(output) AS total FROM fx_tasks WHERE step_slug = 'step_r' GROUP BY run_id) t ON r.run_id = t.run_id)",
    "fx_runs", "fx_tasks",
)
def condition_absent_dep(spark: SparkSession, d: str) -> DataFrame:
    """A step that runs only where a dependency was skipped: its key is absent."""
    total = X.tasks(spark, d).filter("step_slug = 'step_r'").groupBy("run_id").agg(F.sum("output").alias("total"))
    return X.runs(spark, d).select("run_id").join(total, "run_id", "left").select("run_id", F.when(F.col("total").isNull(), "fallback").otherwise("main").alias("branch"))


@query(
    "SELECT run_id, arg_min(step_slug, step_index) AS failed_step FROM (SELECT *, CASE step_slug WHEN 'step_r' THEN 1 WHEN 'step_a' THEN 2 ELSE 3 END AS step_index FROM fx_tasks) WHERE output > 45 GROUP BY run_id",
    "fx_tasks",
)
def condition_first_fail(spark: SparkSession, d: str) -> DataFrame:
    """Of several unmet conditions, the step with the lowest index fails the run."""
    index = F.when(F.col("step_slug") == "step_r", 1).when(F.col("step_slug") == "step_a", 2).otherwise(3)
    return X.tasks(spark, d).filter("output > 45").groupBy("run_id").agg(F.min_by("step_slug", index).alias("failed_step"))


@query(
    f"WITH {_STEP_DONE} SELECT s.run_id, e.step_slug, count(*) AS skipped_parents FROM st s JOIN fx_deps e ON e.dep_slug = s.step_slug WHERE NOT s.done GROUP BY s.run_id, e.step_slug",
    "fx_tasks", "fx_deps",
)
def condition_skip_parent_counts(spark: SparkSession, d: str) -> DataFrame:
    """By how many skipped parents a step's counter falls."""
    edges = X.deps(spark).select("dep_slug", F.col("step_slug").alias("child"))
    joined = _step_states(spark, d).filter("not done").join(F.broadcast(edges), F.col("step_slug") == F.col("dep_slug"))
    return joined.groupBy("run_id", F.col("child").alias("step_slug")).agg(F.count(F.lit(1)).alias("skipped_parents"))


@query("SELECT event_id, NOT json_type(CASE WHEN event_id % 3 = 0 THEN '[' || props || ']' WHEN event_id % 3 = 1 THEN props ELSE 'null' END) = 'ARRAY' AS violation FROM events")
def type_violation(spark: SparkSession, d: str) -> DataFrame:
    """A map's single parent must give an array; objects and JSON null do not pass."""
    e = X.table(spark, d, "events")
    out = F.parse_json(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("null"))
    return e.select("event_id", (~F.startswith(F.schema_of_variant(out), F.lit("ARRAY"))).alias("violation"))


# -- retries -----------------------------------------------------------------------


@query("SELECT run_id, step_slug, task_index, CAST(floor(5 * power(2, attempts_count)) AS INT) AS delay FROM fx_tasks", "fx_tasks")
def retry_delay(spark: SparkSession, d: str) -> DataFrame:
    return X.tasks(spark, d).select("run_id", "step_slug", "task_index", S.retry_delay(F.lit(5), F.col("attempts_count")).alias("delay"))


@query("SELECT msg_id, CAST(least(floor(60 * power(2, read_ct - 1)), 150) AS INT) AS delay FROM fx_msgs", "fx_msgs")
def retry_delay_capped(spark: SparkSession, d: str) -> DataFrame:
    return X.messages(spark, d).select("msg_id", S.message_retry_delay(F.lit(60), F.col("read_ct"), 150).alias("delay"))


@query("SELECT run_id, step_slug, task_index, CASE WHEN attempts_count < 3 THEN 'queued' ELSE 'failed' END AS next_status FROM fx_tasks WHERE status = 'started'", "fx_tasks")
def retry_or_fail(spark: SparkSession, d: str) -> DataFrame:
    return X.tasks(spark, d).filter("status = 'started'").select("run_id", "step_slug", "task_index", F.when(F.col("attempts_count") < 3, "queued").otherwise("failed").alias("next_status"))


@query(
    """SELECT run_id, step_slug, CASE WHEN NOT exhausted THEN 'started' WHEN step_slug = 'step_r' THEN 'failed' ELSE 'skipped' END AS status,
    CASE WHEN exhausted AND step_slug <> 'step_r' THEN 'handler_failed' END AS skip_reason, exhausted AND step_slug = 'step_n' AS cascades
    FROM (SELECT run_id, step_slug, bool_or(attempts_count >= 2) AS exhausted FROM fx_tasks WHERE status = 'started' GROUP BY run_id, step_slug)""",
    "fx_tasks",
)
def when_exhausted_modes(spark: SparkSession, d: str) -> DataFrame:
    """Fail, skip or skip with descendants once a task's attempts are used up."""
    e = X.tasks(spark, d).filter("status = 'started'").groupBy("run_id", "step_slug").agg(F.bool_or(F.col("attempts_count") >= 2).alias("x"))
    x, fails = F.col("x"), F.col("step_slug") == "step_r"
    return e.select("run_id", "step_slug", F.when(~x, "started").when(fails, "failed").otherwise("skipped").alias("status"), F.when(x & ~fails, "handler_failed").alias("skip_reason"), (x & (F.col("step_slug") == "step_n")).alias("cascades"))


_STALLED = "SELECT run_id, step_slug, task_index, CAST(attempts_count + 1 AS INT) AS requeued_count FROM fx_tasks WHERE status = 'started' AND started_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 60 SECOND - INTERVAL 30 SECOND"


@query(f"SELECT *, CASE WHEN requeued_count < 3 THEN 'queued' ELSE 'permanently_stalled' END AS outcome FROM ({_STALLED})", "fx_tasks")
def requeue_stalled(spark: SparkSession, d: str) -> DataFrame:
    """Tasks started longer ago than the timeout and a grace period: queued again, three times at most."""
    from loomspark.operators.state import stalled

    tasks = X.tasks(spark, d).withColumn("requeued_count", (F.col("attempts_count") + 1).cast("int")).withColumn("permanently_stalled_at", F.lit(None).cast("timestamp_ntz"))
    found = stalled(tasks, F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"), F.lit(60))
    return found.select("run_id", "step_slug", "task_index", "requeued_count", "outcome")


# -- queues ------------------------------------------------------------------------

_NOW = "1998-01-01 00:00:00"


def _queue(spark: SparkSession, d: str) -> DataFrame:
    return X.messages(spark, d).withColumn("vt", F.col("enqueued_at") + F.make_dt_interval(secs=(F.col("msg_id") % 7 * 60).cast("decimal(18,6)")))


_VT = "enqueued_at + to_seconds(CAST(msg_id % 7 * 60 AS INT))"


@query(
    f"SELECT queue_name, msg_id, CAST(read_ct + 1 AS INT) AS read_ct, CAST(epoch_us(TIMESTAMP '2024-01-10 00:00:30') AS BIGINT) AS vt_us FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY msg_id) AS p FROM fx_msgs WHERE {_VT} <= TIMESTAMP '2024-01-10 00:00:00') WHERE p <= 50",
    "fx_msgs",
)
def visible_read_topk(spark: SparkSession, d: str) -> DataFrame:
    """A read of whole queues at a moment within the data, with the visibility that it gives what it read."""
    got = queue.read_visible(_queue(spark, d), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), 50, 30)
    return got.select("queue_name", "msg_id", "read_ct", F.unix_micros(F.col("vt").cast("timestamp")).alias("vt_us"))


@query(
    f"SELECT queue_name, msg_id, CAST(read_ct + 1 AS INT) AS read_ct FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY msg_id) AS p FROM fx_msgs WHERE {_VT} <= TIMESTAMP '2024-01-15 12:00:00') WHERE p <= 50",
    "fx_msgs",
)
def visible_read_whole(spark: SparkSession, d: str) -> DataFrame:
    """The first visible messages of each whole queue, at a time when a part of them is visible."""
    got = queue.read_visible(_queue(spark, d), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"), 50, 30)
    return got.select("queue_name", "msg_id", "read_ct")


@query(
    "SELECT m.msg_id, CAST(epoch_us(TIMESTAMP '1998-01-01 00:00:00' + to_seconds(o.off)) AS BIGINT) AS vt_us FROM fx_msgs m JOIN (SELECT unnest([1, 5, 9, 999999999]) AS id, unnest([10, 0, 3600, 5]) AS off) o ON m.msg_id = o.id",
    "fx_msgs",
)
def set_vt_batch(spark: SparkSession, d: str) -> DataFrame:
    moved = queue.set_visibility(_queue(spark, d), [1, 5, 9, 999999999], [10, 0, 3600, 5], F.lit(_NOW).cast("timestamp_ntz"))
    return moved.select("msg_id", F.unix_micros(F.col("vt").cast("timestamp")).alias("vt_us"))


@query("SELECT run_id, step_slug, task_index, CAST(epoch_us(started_at + to_seconds(CASE step_slug WHEN 'step_r' THEN 30 WHEN 'step_a' THEN 0 ELSE 300 END)) AS BIGINT) AS first_vt_us, CAST(epoch_us(started_at + to_seconds(60 + 2)) AS BIGINT) AS lease_vt_us FROM fx_tasks", "fx_tasks")
def delayed_start_vt(spark: SparkSession, d: str) -> DataFrame:
    """First visibility after a step's start delay, and visibility while a task runs: timeout plus two seconds."""
    delay = F.when(F.col("step_slug") == "step_r", 30).when(F.col("step_slug") == "step_a", 0).otherwise(300)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return X.tasks(spark, d).select("run_id", "step_slug", "task_index", us(S.visible_at(F.col("started_at"), delay)).alias("first_vt_us"), us(S.visible_at(F.col("started_at"), F.lit(62))).alias("lease_vt_us"))


@query("SELECT msg_id, CASE WHEN read_ct = 3 THEN 'archived' ELSE 'active' END AS place FROM fx_msgs", "fx_msgs")
def archive_split(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    active, gone = queue.archive(q, q.filter("read_ct = 3").select("msg_id"), F.lit(_NOW).cast("timestamp_ntz"))
    return active.select("msg_id", F.lit("active").alias("place")).unionByName(gone.select("msg_id", F.lit("archived").alias("place")))


@query(
    "SELECT m.msg_id, CASE WHEN EXISTS (SELECT 1 FROM fx_tasks t WHERE t.run_id = m.msg_id AND t.status = 'queued' AND t.step_slug = 'step_n' AND t.task_index = 0) THEN 'matched' ELSE 'unmatched' END AS phase FROM fx_msgs m",
    "fx_msgs", "fx_tasks",
)
def two_phase_match(spark: SparkSession, d: str) -> DataFrame:
    tasks = X.tasks(spark, d).filter("step_slug = 'step_n' and task_index = 0").select(F.col("run_id").alias("msg_id"), "status")
    hit, missed = queue.match_tasks(X.messages(spark, d).select("msg_id"), tasks)
    return hit.select("msg_id", F.lit("matched").alias("phase")).unionByName(missed.select("msg_id", F.lit("unmatched").alias("phase")))


@query(
    "SELECT msg_id, CASE WHEN queue_name = 'q_err' AND read_ct < 3 THEN 'retry' WHEN queue_name = 'q_err' THEN 'archived_failed' ELSE 'archived' END AS outcome, CAST(CASE WHEN queue_name = 'q_err' AND read_ct < 3 THEN least(floor(3 * power(2, read_ct - 1)), 300) ELSE 0 END AS INT) AS delay FROM fx_msgs",
    "fx_msgs",
)
def queue_handler_retry(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose handler failed come back until their reads are used up."""
    return queue.settle(X.messages(spark, d), F.col("queue_name") == "q_err", limit=2, base=3).select("msg_id", "outcome", "delay")


@query(
    f"SELECT msg_id, queue_name, read_ct, CAST(epoch_us({_VT}) AS BIGINT) AS vt_us FROM fx_msgs UNION ALL SELECT msg_id + 1000000000000, 'q_new', 0, CAST(epoch_us(TIMESTAMP '1998-01-01 00:00:05') AS BIGINT) FROM fx_msgs", "fx_msgs"
)
def enqueue_batch(spark: SparkSession, d: str) -> DataFrame:
    """A batch of all messages sent to the whole queue, visible after its delay."""
    base = _queue(spark, d).select("queue_name", "msg_id", "read_ct", "enqueued_at", "vt", "message")
    new = X.messages(spark, d).select(F.lit("q_new").alias("queue_name"), (F.col("msg_id") + 1000000000000).alias("msg_id"), "message")
    sent = queue.send_batch(base, new, F.lit(_NOW).cast("timestamp_ntz"), 5)
    return sent.select("msg_id", "queue_name", "read_ct", F.unix_micros(F.col("vt").cast("timestamp")).alias("vt_us"))


@query("SELECT msg_id, queue_name, read_ct FROM fx_msgs UNION ALL SELECT msg_id + 1000000000000, 'q_new', 0 FROM fx_msgs", "fx_msgs")
def enqueue_batch_whole(spark: SparkSession, d: str) -> DataFrame:
    """A batch made from all messages, appended to the whole queue."""
    base = _queue(spark, d).select("queue_name", "msg_id", "read_ct", "enqueued_at", "vt", "message")
    new = X.messages(spark, d).select(F.lit("q_new").alias("queue_name"), (F.col("msg_id") + 1000000000000).alias("msg_id"), "message")
    return queue.send_batch(base, new, F.lit(_NOW).cast("timestamp_ntz"), 5).select("msg_id", "queue_name", "read_ct")


@query("SELECT count(*) AS remaining, min(msg_id) AS first_id FROM fx_msgs WHERE msg_id % 10 <> 0", "fx_msgs")
def delete_messages(spark: SparkSession, d: str) -> DataFrame:
    q = _queue(spark, d)
    return queue.delete(q, q.filter("msg_id % 10 = 0").select("msg_id")).agg(F.count(F.lit(1)).alias("remaining"), F.min("msg_id").alias("first_id"))


@query("SELECT user_id, msg_id, row_number() OVER (PARTITION BY user_id ORDER BY msg_id) AS seq FROM fx_msgs", "fx_msgs")
def ordinality(spark: SparkSession, d: str) -> DataFrame:
    return X.messages(spark, d).select("user_id", "msg_id", F.row_number().over(Window.partitionBy("user_id").orderBy("msg_id")).cast("long").alias("seq"))
