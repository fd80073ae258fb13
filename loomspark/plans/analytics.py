"""Queries over the workflow views, part two: workers, events, definitions, monitoring, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import scalars as S
from loomspark.operators import definitions, events, state, workers
from loomspark.plans.relational import query
from loomspark.sources import fixtures as X

_AS_OF = "(SELECT max(ts) FROM events)"


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _workers(spark: SparkSession, d: str) -> DataFrame:
    """Users as workers: their last event is their last heartbeat; every tenth is stopped, every seventh deprecated."""
    beats = X.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_heartbeat_at"))
    flag = lambda n: F.when(F.col("user_id") % n == 0, F.col("last_heartbeat_at"))
    return beats.withColumn("stopped_at", flag(10)).withColumn("deprecated_at", flag(7))


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "events").agg(F.max("ts").alias("as_of"))


@query(f"SELECT user_id FROM (SELECT user_id, max(ts) AS hb FROM events GROUP BY user_id) WHERE user_id % 10 <> 0 AND user_id % 7 <> 0 AND hb > {_AS_OF} - INTERVAL 6 HOUR")
def alive_workers(spark: SparkSession, d: str) -> DataFrame:
    w = _workers(spark, d).crossJoin(F.broadcast(_as_of(spark, d)))
    return workers.alive(w, F.col("as_of"), 6 * 3600).select("user_id")


@query(
    f"""WITH w AS (SELECT user_id, max(ts) AS hb FROM events GROUP BY user_id), f AS (SELECT DISTINCT user_id % 20 AS fn FROM events)
    SELECT 'fn_' || CAST(fn AS VARCHAR) AS function_name FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.user_id % 20 = f.fn AND w.user_id % 10 <> 0 AND w.user_id % 7 <> 0 AND w.hb > {_AS_OF} - INTERVAL 6 HOUR)"""
)
def ensure_workers(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("fn_"), (F.col("user_id") % 20).cast("string")).alias("function_name")
    functions = X.table(spark, d, "events").select(name).distinct().select("function_name", F.lit(True).alias("enabled"), F.lit(6 * 3600).alias("debounce_seconds"), F.lit(None).cast("timestamp_ntz").alias("last_invoked_at"))
    functions = functions.crossJoin(F.broadcast(_as_of(spark, d)))
    return workers.functions_to_start(functions, _workers(spark, d).select(name, "last_heartbeat_at", "stopped_at", "deprecated_at"), F.col("as_of"))


@query(
    """SELECT user_id, CAST(count(*) FILTER (gap > 3600) AS BIGINT) AS n_gaps, max(gap) AS longest_gap FROM
    (SELECT user_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1000000) AS BIGINT) AS gap FROM events) GROUP BY user_id"""
)
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    return workers.heartbeat_gaps(X.table(spark, d, "events"), "user_id", "ts", 3600)


_STATES = "CASE turn % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'starting' WHEN 2 THEN 'running' WHEN 3 THEN 'stopping' ELSE 'stopped' END"


@query(
    f"""SELECT conv_id, turn, f AS from_state, s AS state FROM (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM
    (SELECT conv_id, turn, {_STATES} AS s FROM conversations)) WHERE f IS NOT NULL AND (f, s) NOT IN (('created','starting'),('starting','running'),('running','deprecated'),('running','stopping'),('deprecated','stopping'),('stopping','stopped'))"""
)
def worker_transitions_valid(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ["created", "starting", "running", "stopping", "stopped"]))
    log = X.table(spark, d, "conversations").select("conv_id", "turn", F.get(names, (F.col("turn") % 5).cast("int")).alias("state"))
    return workers.invalid_transitions(log, "conv_id", "state", ["turn"])


_EVENT_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END"


def _run_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("started")
    return X.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts", status.alias("status"))


@query(
    f"""SELECT user_id AS run_id, coalesce(arg_min(s, event_id) FILTER (s <> 'started'), 'started') AS status, count(*) AS n_events
    FROM (SELECT user_id, event_id, {_EVENT_STATUS} AS s FROM events) GROUP BY user_id"""
)
def event_fold_run(spark: SparkSession, d: str) -> DataFrame:
    """A run's status after its log: the first terminal status wins."""
    return events.fold_status(_run_events(spark, d), ["run_id"], events.RUN_RANK, events.RUN_TERMINAL, ["event_id"])


@query(
    """SELECT run_id, step_slug, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN bool_or(status = 'started') THEN 'started' ELSE 'created' END AS status, count(*) AS n_events
    FROM (SELECT run_id, step_slug, CASE status WHEN 'queued' THEN 'created' ELSE status END AS status FROM fx_tasks) GROUP BY run_id, step_slug""",
    "fx_tasks",
)
def event_fold_step(spark: SparkSession, d: str) -> DataFrame:
    log = X.tasks(spark, d).withColumn("status", F.when(F.col("status") == "queued", "created").otherwise(F.col("status")))
    return events.fold_status(log, ["run_id", "step_slug"], events.STEP_RANK, events.STEP_TERMINAL, ["task_index"])


@query(f"SELECT user_id AS run_id, event_id, 'run:' || {_EVENT_STATUS} AS event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS seq FROM events")
def event_log_order(spark: SparkSession, d: str) -> DataFrame:
    log = events.event_order(_run_events(spark, d), ["run_id"], ["event_id"])
    return log.select("run_id", "event_id", events.event_name(F.col("status")).alias("event_type"), "seq")


def _definitions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    slugs = ["root", "step_r", "step_a", "step_n", "leaf1", "leaf2"]
    steps = spark.createDataFrame([("flow_even", s, "map" if s == "step_n" else "single", k) for k, s in enumerate(slugs)], "flow_slug string, step_slug string, step_type string, step_index int")
    return steps, X.deps(spark).withColumn("flow_slug", F.lit("flow_even"))


_STEPS = "SELECT * FROM (VALUES ('root', 'single', 0), ('step_r', 'single', 1), ('step_a', 'single', 2), ('step_n', 'map', 3), ('leaf1', 'single', 4), ('leaf2', 'single', 5)) AS s(step_slug, step_type, step_index)"


@query(
    f"""WITH s AS ({_STEPS}), j AS (SELECT step_index, '{{"slug":"' || step_slug || '","stepType":"' || step_type || '","dependencies":[' ||
    coalesce((SELECT string_agg('"' || dep_slug || '"', ',' ORDER BY dep_slug) FROM fx_deps d WHERE d.step_slug = s.step_slug), '') || ']}}' AS x FROM s)
    SELECT 'flow_even' AS flow_slug, '{{"steps":[' || string_agg(x, ',' ORDER BY step_index) || ']}}' AS shape FROM j""",
    "fx_deps",
)
def flow_shape_json(spark: SparkSession, d: str) -> DataFrame:
    return definitions.shape_json(*_definitions(spark))


@query(f"WITH s AS ({_STEPS}) SELECT step_index, CASE WHEN step_index = 5 THEN 'missing in second: leaf2' WHEN step_index = 3 THEN 'map vs single' ELSE 'step_a vs step_x' END AS difference FROM s WHERE step_index IN (2, 3, 5)")
def shape_diff(spark: SparkSession, d: str) -> DataFrame:
    steps, _ = _definitions(spark)
    other = steps.filter("step_index < 5").withColumn("step_slug", F.when(F.col("step_index") == 2, "step_x").otherwise(F.col("step_slug"))).withColumn("step_type", F.lit("single"))
    return definitions.shape_differences(steps, other)


@query("SELECT c_custkey AS key, 'old_' || c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def upsert_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Known keys keep their options, new ones are added."""
    c = X.table(spark, d, "customer")
    known = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.concat(F.lit("old_"), "c_mktsegment").alias("value"))
    return definitions.upsert_missing(known, c.select(F.col("c_custkey").alias("key"), F.lit("new").alias("value")), ["key"])


@query("SELECT p_partkey, p_name, p_name IS NOT NULL AND regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AND length(p_name) <= 128 AND p_name <> 'run' AS valid, regexp_full_match(replace(replace(p_name, '#', '_'), ' ', '_'), '[A-Za-z_][A-Za-z0-9_]*') AS valid_cleaned FROM part")
def slug_validation(spark: SparkSession, d: str) -> DataFrame:
    cleaned = F.replace(F.replace("p_name", F.lit("#"), F.lit("_")), F.lit(" "), F.lit("_"))
    return X.table(spark, d, "part").select("p_partkey", "p_name", S.valid_slug(F.col("p_name")).alias("valid"), S.valid_slug(cleaned).alias("valid_cleaned"))


# -- monitoring --------------------------------------------------------------------

_US = "CAST(epoch_us({}) AS BIGINT)"


def _us(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


@query(f"SELECT run_id, status, {_US.format('started_at')} AS started_us FROM fx_runs WHERE flow_slug = 'flow_even' ORDER BY started_at DESC, run_id DESC LIMIT 10", "fx_runs")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    top = X.runs(spark, d).filter("flow_slug = 'flow_even'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(10)
    return top.select("run_id", "status", _us("started_at").alias("started_us"))


@query("SELECT run_id, step_slug, task_index, status FROM fx_tasks WHERE status IN ('queued', 'started')", "fx_tasks")
def active_tasks(spark: SparkSession, d: str) -> DataFrame:
    return X.tasks(spark, d).filter(F.col("status").isin("queued", "started")).select("run_id", "step_slug", "task_index", "status")


@query(
    "SELECT run_id, step_slug, CAST((epoch_us(max(started_at)) - epoch_us(min(started_at))) / 1000000 AS BIGINT) AS duration_seconds FROM fx_tasks GROUP BY run_id, step_slug", "fx_tasks"
)
def step_timeline(spark: SparkSession, d: str) -> DataFrame:
    span = S.duration_seconds(F.min("started_at"), F.max("started_at")).cast("long")
    return X.tasks(spark, d).groupBy("run_id", "step_slug").agg(span.alias("duration_seconds"))


@query("SELECT r.run_id, t.step_slug, CAST(count(*) AS BIGINT) AS open_tasks FROM fx_runs r JOIN fx_tasks t ON t.run_id = r.run_id WHERE r.status = 'failed' AND t.status <> 'completed' GROUP BY r.run_id, t.step_slug", "fx_runs", "fx_tasks")
def failed_steps(spark: SparkSession, d: str) -> DataFrame:
    failed = X.runs(spark, d).filter("status = 'failed'").select("run_id")
    return X.tasks(spark, d).filter("status <> 'completed'").join(failed, "run_id").groupBy("run_id", "step_slug").agg(F.count(F.lit(1)).alias("open_tasks"))


@query(f"WITH s AS ({_STEPS}) SELECT s.step_slug, coalesce(string_agg(d.dep_slug, ',' ORDER BY d.dep_slug), '') AS dependencies FROM s LEFT JOIN fx_deps d ON d.step_slug = s.step_slug GROUP BY s.step_slug", "fx_deps")
def step_dependencies(spark: SparkSession, d: str) -> DataFrame:
    steps, deps = _definitions(spark)
    joined = steps.select("step_slug").join(F.broadcast(deps.select("step_slug", "dep_slug")), "step_slug", "left")
    return joined.groupBy("step_slug").agg(F.array_join(F.array_sort(F.collect_list("dep_slug")), ",").alias("dependencies"))


@query("SELECT run_id, step_slug, task_index, CAST(date_diff('day', started_at, TIMESTAMP '1998-01-01 00:00:00') AS INT) AS stuck_days FROM fx_tasks WHERE status = 'started' AND started_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 5 MINUTE", "fx_tasks")
def stalled_now(spark: SparkSession, d: str) -> DataFrame:
    now = _ntz("1998-01-01 00:00:00")
    old = X.tasks(spark, d).filter((F.col("status") == "started") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(5))))
    return old.select("run_id", "step_slug", "task_index", F.datediff(now.cast("date"), F.col("started_at").cast("date")).alias("stuck_days"))


@query("SELECT run_id, step_slug, task_index FROM fx_tasks WHERE status = 'started' AND attempts_count >= 2 AND started_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 90 SECOND", "fx_tasks")
def permanently_stalled(spark: SparkSession, d: str) -> DataFrame:
    tasks = X.tasks(spark, d).withColumn("requeued_count", (F.col("attempts_count") + 1).cast("int")).withColumn("permanently_stalled_at", F.lit(None).cast("timestamp_ntz"))
    after = state.requeue_stalled(tasks, _ntz("1997-01-01 00:00:00"), F.lit(60))
    return after.filter("permanently_stalled_at is not null").select("run_id", "step_slug", "task_index")


@query("SELECT run_id, step_slug, 'handler_failed' AS skip_reason FROM fx_tasks WHERE status = 'started' AND attempts_count >= 2 AND step_slug <> 'step_r' GROUP BY run_id, step_slug", "fx_tasks")
def skipped_by_failure(spark: SparkSession, d: str) -> DataFrame:
    from loomspark.plans.relational import when_exhausted_modes

    return when_exhausted_modes(spark, d).filter("skip_reason = 'handler_failed'").select("run_id", "step_slug", "skip_reason")


@query("SELECT read_ct, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM fx_msgs GROUP BY read_ct", "fx_msgs")
def retry_histogram(spark: SparkSession, d: str) -> DataFrame:
    n = X.messages(spark, d).groupBy("read_ct").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("read_ct", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("share"))


_LAT = "(SELECT event_id, 1 + event_id % 3 AS read_ct, value AS latency FROM events)"


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "events").select((1 + F.col("event_id") % 3).alias("read_ct"), F.col("value").alias("latency"))


@query(f"SELECT read_ct, count(*) AS n, round(avg(latency), 4) AS mean, round(min(latency), 4) AS least, round(max(latency), 4) AS most, round(sum(latency), 2) AS total, round(stddev(latency), 4) AS deviation FROM {_LAT} GROUP BY read_ct")
def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c, n=4: F.round(c, n)
    v = "latency"
    return _latency(spark, d).groupBy("read_ct").agg(F.count(F.lit(1)).alias("n"), r(F.avg(v)).alias("mean"), r(F.min(v)).alias("least"), r(F.max(v)).alias("most"), r(F.sum(v), 2).alias("total"), r(F.stddev(v)).alias("deviation"))


@query(f"SELECT round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.75), 4) AS p75, round(quantile_cont(latency, 0.9), 4) AS p90, round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99 FROM {_LAT}")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    from loomspark.functions.quantiles import exact_quantiles

    points = [0.5, 0.75, 0.9, 0.95, 0.99]
    names = [f"p{int(100 * p)}" for p in points]
    return exact_quantiles(_latency(spark, d), "latency", points, names).select(*[F.round(n, 4).alias(n) for n in names])


@query("SELECT hour, n, CAST(sum(n) OVER (ORDER BY hour) AS BIGINT) AS running FROM (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1)")
def throughput_running_total(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour with a running total; the window runs over hours, not events."""
    hour = F.floor(_us("ts") / 3600000000).cast("long")
    n = X.table(spark, d, "events").groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("running", F.sum("n").over(Window.orderBy("hour")))


@query(f"SELECT read_ct, CAST(CASE WHEN latency < 0 THEN 0 WHEN latency >= 200 THEN 21 ELSE floor(latency / 10) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM {_LAT} GROUP BY 1, 2")
def width_bucket_hist(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.width_bucket("latency", F.lit(0.0), F.lit(200.0), F.lit(20))
    return _latency(spark, d).groupBy("read_ct", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT second, second - (SELECT CAST(epoch_us(date_trunc('second', min(ts))) / 1000000 AS BIGINT) FROM events) AS since, n FROM (SELECT CAST(epoch_us(date_trunc('second', ts)) / 1000000 AS BIGINT) AS second, count(*) AS n FROM events GROUP BY 1)")
def per_second_distribution(spark: SparkSession, d: str) -> DataFrame:
    """All events by second, and the seconds since the first."""
    e = X.table(spark, d, "events").select(F.floor(_us("ts") / 1000000).cast("long").alias("second"))
    n = e.groupBy("second").agg(F.count(F.lit(1)).alias("n"))
    first = e.agg(F.min("second").alias("first"))
    return n.crossJoin(F.broadcast(first)).select("second", (F.col("second") - F.col("first")).alias("since"), "n")


@query("SELECT CAST(epoch_us(date_trunc('second', ts)) / 1000000 AS BIGINT) AS second, count(*) AS n FROM events GROUP BY 1")
def per_second_distribution_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same over all events."""
    second = F.floor(_us("ts") / 1000000).cast("long")
    return X.table(spark, d, "events").groupBy(second.alias("second")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'open_runs' AS check_name, count(*) AS n, CAST(count(*) FILTER (status = 'started') AS BIGINT) AS bad FROM fx_runs UNION ALL
    SELECT 'tasks', count(*), CAST(count(*) FILTER (status = 'queued') AS BIGINT) FROM fx_tasks UNION ALL
    SELECT 'messages', count(*), CAST(count(*) FILTER (read_ct > 2) AS BIGINT) FROM fx_msgs UNION ALL
    SELECT 'deps', count(*), CAST(count(*) FILTER (dep_slug = step_slug) AS BIGINT) FROM fx_deps""",
    "fx_runs", "fx_tasks", "fx_msgs", "fx_deps",
)
def migration_check(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, df, bad: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("n"), F.count_if(F.expr(bad)).alias("bad"))
    parts = [part("open_runs", X.runs(spark, d), "status = 'started'"), part("tasks", X.tasks(spark, d), "status = 'queued'"), part("messages", X.messages(spark, d), "read_ct > 2"), part("deps", X.deps(spark), "dep_slug = step_slug")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "SELECT 'runs' AS kept, count(*) AS n FROM fx_runs WHERE NOT (status IN ('completed', 'failed') AND started_at < TIMESTAMP '1996-01-01 00:00:00') UNION ALL SELECT 'tasks', count(*) FROM fx_tasks t WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE r.run_id = t.run_id AND r.status IN ('completed', 'failed') AND r.started_at < TIMESTAMP '1996-01-01 00:00:00')",
    "fx_runs", "fx_tasks",
)
def prune_runs(spark: SparkSession, d: str) -> DataFrame:
    runs, (tasks,) = state.prune(X.runs(spark, d).withColumn("ended_at", F.col("started_at")), [X.tasks(spark, d)], _ntz("1996-01-01 00:00:00"))
    return runs.agg(F.lit("runs").alias("kept"), F.count(F.lit(1)).alias("n")).unionByName(tasks.agg(F.lit("tasks").alias("kept"), F.count(F.lit(1)).alias("n")))


@query("SELECT count(*) AS deleted FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def log_cleanup(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events").select("ts").crossJoin(F.broadcast(_as_of(spark, d)))
    return e.filter(F.col("ts") < F.col("as_of") - F.make_dt_interval(hours=F.lit(24))).agg(F.count(F.lit(1)).alias("deleted"))


@query(
    """SELECT r.run_id, '{"run_id":' || CAST(r.run_id AS VARCHAR) || ',"status":"' || r.status || '"}' AS run, coalesce(s.steps, '[]') AS steps FROM fx_runs r LEFT JOIN
    (SELECT run_id, '[' || string_agg('{"step_slug":"' || step_slug || '","n":' || CAST(n AS VARCHAR) || '}', ',' ORDER BY step_slug) || ']' AS steps FROM (SELECT run_id, step_slug, count(*) AS n FROM fx_tasks GROUP BY run_id, step_slug) GROUP BY run_id) s ON s.run_id = r.run_id""",
    "fx_runs", "fx_tasks",
)
def snapshot_json(spark: SparkSession, d: str) -> DataFrame:
    states = X.tasks(spark, d).groupBy("run_id", "step_slug").agg(F.count(F.lit(1)).alias("n"))
    return events.snapshot(X.runs(spark, d).select("run_id", "status"), states)


@query(
    """SELECT vec_id, round(sim, 6) AS similarity FROM (SELECT e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS sim FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q)
    WHERE sim > 0.1 ORDER BY sim DESC, vec_id LIMIT 20"""
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors to one query vector, above a threshold."""
    e = X.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    q = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    scored = e.crossJoin(F.broadcast(q)).select("vec_id", S.cosine_similarity(F.col("embedding"), F.col("q")).alias("sim")).filter("sim > 0.1")
    return scored.orderBy(F.desc("sim"), "vec_id").limit(20).select("vec_id", F.round("sim", 6).alias("similarity"))


@query(
    "SELECT o.run_id, o.status AS old_status, n.status AS new_status FROM fx_runs o JOIN (SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'failed' ELSE status END AS status FROM fx_runs) n ON n.run_id = o.run_id WHERE o.status <> n.status",
    "fx_runs",
)
def cdc_status_change(spark: SparkSession, d: str) -> DataFrame:
    from loomspark.sources.triggers import changed_rows

    old = X.runs(spark, d).select("run_id", "status")
    new = old.withColumn("status", F.when(F.col("run_id") % 5 == 0, "failed").otherwise(F.col("status")))
    return changed_rows(old, new, "run_id", "status")


@query("SELECT CAST(c_custkey AS VARCHAR) AS run_id, s.step_slug, CASE WHEN s.step_slug = 'fetch' THEN 'started' ELSE 'created' END AS status FROM customer, (VALUES ('fetch'), ('report')) AS s(step_slug) WHERE c_acctbal < 0")
def trigger_start_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run for each matching row: the state tables after the start."""
    from loomspark.plans.flow import Flow
    from loomspark.sources.triggers import start_for_rows

    flow = Flow("on_debt").step("fetch", None).step("report", None, ["fetch"])
    rows = X.table(spark, d, "customer").filter("c_acctbal < 0")
    snap = start_for_rows(flow, rows, F.col("c_custkey"), F.struct("c_custkey", "c_acctbal"), _ntz("1998-01-01 00:00:00"))
    return snap.states.select("run_id", "step_slug", "status")


# -- compiled flows ----------------------------------------------------------------


@query("SELECT run_id, count(x) AS n, CAST(coalesce(sum(x * 2 + 1), 0) AS BIGINT) AS total FROM (SELECT r.run_id, a.x FROM fx_runs r LEFT JOIN (SELECT run_id, unnest(items) AS x FROM fx_arrays) a ON a.run_id = r.run_id) GROUP BY run_id", "fx_runs", "fx_arrays")
def handler_udf_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A Python map handler, carried in Arrow batches."""
    from loomspark.plans.batch import PythonHandler, run_batch
    from loomspark.plans.flow import Flow

    flow = Flow("doubled").map("twice", PythonHandler(lambda x, _: 2 * x + 1, "bigint")).step("total", lambda x: F.aggregate(x.deps["twice"], F.lit(0).cast("bigint"), lambda s, v: s + v), ["twice"])
    done = run_batch(flow, X.run_arrays(spark, d), input_col="items")
    return done.select("run_id", F.size("twice.output").cast("long").alias("n"), F.col("total.output").alias("total"))


@query(
    """SELECT event_id, CASE WHEN k < 3 THEN 'completed' ELSE 'skipped' END AS low, CASE WHEN k >= 3 THEN 'completed' ELSE 'skipped' END AS high,
    CASE WHEN k < 3 THEN 'created_low' ELSE 'created_high' END AS joined, CASE WHEN k = 9 THEN 'failed' ELSE 'completed' END AS run_status
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k FROM events)"""
)
def batch_flow_conditional(spark: SparkSession, d: str) -> DataFrame:
    """Branches by condition, a join step that sees which one ran, and a run that a condition fails."""
    from loomspark.plans.batch import run_batch
    from loomspark.plans.flow import Flow

    k = F.try_variant_get(F.parse_json("props"), "$.k", "int") % 10
    runs = X.table(spark, d, "events").select("event_id", F.struct(k.alias("k"), F.when(k < 3, "low").otherwise("high").alias("route"), F.when(k == 9, "no").otherwise("yes").alias("go")).alias("input"))
    flow = (
        Flow("routes").step("low", lambda x: x.flow_input["k"], if_={"route": "low"}).step("high", lambda x: x.flow_input["k"], if_={"route": "high"})
        .step("joined", lambda x: F.when(x.deps["low"].isNotNull(), "created_low").otherwise("created_high"), ["low", "high"])
        .step("start", lambda x: x.flow_input["go"]).step("gate", lambda x: x.deps["start"], ["start"])
        .step("last", lambda x: x.deps["gate"], ["gate"], if_={"gate": "yes"}, when_unmet="fail")
    )
    done = run_batch(flow, runs, run_col="event_id")
    return done.select("event_id", F.col("low.status").alias("low"), F.col("high.status").alias("high"), F.col("joined.output").alias("joined"), "run_status")


@query(
    """SELECT run_id, CASE WHEN m IS NULL OR m <= 40 THEN 'completed' WHEN p = 0 THEN 'failed' ELSE 'skipped' END AS checked, CASE WHEN m > 40 AND p = 0 THEN 'failed' ELSE 'completed' END AS run_status, coalesce(n, 0) AS n
    FROM (SELECT r.run_id, r.run_id % 2 AS p, max(a.x) AS m, count(a.x) AS n FROM fx_runs r LEFT JOIN (SELECT run_id, unnest(items) AS x FROM fx_arrays) a ON a.run_id = r.run_id GROUP BY r.run_id)""",
    "fx_runs", "fx_arrays",
)
def batch_flow_fail_modes(spark: SparkSession, d: str) -> DataFrame:
    """A failing map element: by mode, its step fails the run or is skipped."""
    from loomspark.plans.batch import Outcome, run_batch
    from loomspark.plans.flow import Flow

    runs = X.run_arrays(spark, d)
    both = []
    for mode, parity in (("fail", 0), ("skip", 1)):
        flow = Flow("modes").map("checked", lambda x: Outcome(x.item, x.item <= 40, "too large"), when_exhausted=mode)
        done = run_batch(flow, runs.filter(F.col("run_id") % 2 == parity), input_col="items")
        both.append(done.select("run_id", F.col("checked.status").alias("checked"), "run_status", F.size("items").cast("long").alias("n")))
    return both[0].unionByName(both[1])
