"""Definition tables: upserts, shapes from tables, differences of shapes, deletion."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.plans.flow import COMPARED, DEFAULTS, MODES, check_options, check_pattern, check_slug


def upsert_missing(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``known`` plus the rows of ``new`` whose key is not there; known options stay as they are."""
    return known.unionByName(new.join(known.select(*keys), keys, "left_anti"))


FLOWS = "flow_slug string, opt_max_attempts int, opt_base_delay int, opt_timeout int"
STEPS = (
    "flow_slug string, step_slug string, step_type string, step_index int, deps_count int, opt_max_attempts int, opt_base_delay int, opt_timeout int, "
    "opt_start_delay int, required_input_pattern string, forbidden_input_pattern string, when_unmet string, when_exhausted string"
)
DEPS = "flow_slug string, dep_slug string, step_slug string"
_OPTIONS = ("max_attempts", "base_delay", "timeout", "start_delay")


def create_flow(flows: DataFrame, slug: str, **options: int | None) -> DataFrame:
    """``flows`` with a flow more; unset options take the defaults, and a known flow keeps its own."""
    found = {**DEFAULTS, **check_options(options, step=False)}
    row = flows.sparkSession.createDataFrame([(check_slug(slug), *[found[o] for o in _OPTIONS[:3]])], FLOWS)
    return upsert_missing(flows, row, ["flow_slug"])


def add_step(
    steps: DataFrame, deps: DataFrame, flow: str, slug: str, depends_on: list[str], kind: str = "single", *, if_: dict | None = None, if_not: dict | None = None,
    when_unmet: str = "skip", when_exhausted: str = "fail", **options: int | None,
) -> tuple[DataFrame, DataFrame]:
    """(steps, deps) with one step more at the next index; nothing changes for a known step.

    Only the columns that ``steps`` has are filled, so a narrow table works too.
    """
    if kind == "map" and len(depends_on) > 1:
        raise ValueError("a map has one source at most")
    if when_unmet not in MODES or when_exhausted not in MODES:
        raise ValueError(f"modes are {', '.join(MODES)}")
    found = check_options(options, step=True)
    text = lambda p: None if check_pattern(p) is None else json.dumps(p)
    value = {"flow_slug": flow, "step_slug": check_slug(slug), "step_type": kind, "deps_count": len(depends_on), "required_input_pattern": text(if_), "forbidden_input_pattern": text(if_not), "when_unmet": when_unmet, "when_exhausted": when_exhausted}
    value |= {f"opt_{o}": found.get(o) for o in _OPTIONS}
    index = (F.coalesce(F.max("step_index"), F.lit(-1)) + 1).cast("int").alias("step_index")
    row = steps.filter(F.col("flow_slug") == flow).agg(index)
    row = row.select(*[F.col(f.name) if f.name == "step_index" else F.lit(value.get(f.name)).cast(f.dataType).alias(f.name) for f in steps.schema.fields])
    edges = steps.sparkSession.createDataFrame([(flow, d, slug) for d in depends_on], DEPS)
    return upsert_missing(steps, row, ["flow_slug", "step_slug"]), upsert_missing(deps, edges, ["flow_slug", "dep_slug", "step_slug"])


def tune(table: DataFrame, where: Column, **options: int) -> DataFrame:
    """Definition rows with new options; a run looks them up when it executes, so nothing is compiled again."""
    found = check_options(options, step="opt_start_delay" in table.columns)
    return table.withColumns({f"opt_{o}": F.when(where, F.lit(v)).otherwise(F.col(f"opt_{o}")) for o, v in found.items()})


def effective_options(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow_slug, step_slug, options): a step's own option, else its flow's."""
    flow = flows.select("flow_slug", *[F.col(f"opt_{o}").alias(f"flow_{o}") for o in _OPTIONS[:3]])
    chosen = [F.coalesce(f"opt_{o}", f"flow_{o}").alias(o) for o in _OPTIONS[:3]]
    return steps.join(flow, "flow_slug").select("flow_slug", "step_slug", *chosen, F.coalesce("opt_start_delay", F.lit(0)).alias("start_delay"))


def read_definition(flows: DataFrame, steps: DataFrame, slug: str) -> DataFrame:
    """(flow_slug, flow, steps): one flow with its steps in order, both as JSON; no row for an unknown flow."""
    rows = F.array_sort(F.collect_list(F.struct("step_index", *[c for c in steps.columns if c not in ("step_index", "flow_slug")])))
    grouped = steps.filter(F.col("flow_slug") == slug).groupBy("flow_slug").agg(F.to_json(rows).alias("steps"))
    mine = flows.filter(F.col("flow_slug") == slug).select("flow_slug", F.to_json(F.struct(*flows.columns)).alias("flow"))
    return mine.join(grouped, "flow_slug", "left").withColumn("steps", F.coalesce("steps", F.lit("[]")))


def _pattern(column: str) -> Column:
    """A condition as a shape has it: whether it is defined, and its value where it is."""
    return F.struct(F.col(column).isNotNull().alias("defined"), F.try_parse_json(column).alias("value"))


def shape_json(steps: DataFrame, deps: DataFrame) -> DataFrame:
    """(flow_slug, shape): steps in order with their sorted dependencies, as JSON text.

    Modes and conditions are there where ``steps`` has their columns.
    """
    sources = deps.groupBy("flow_slug", "step_slug").agg(F.array_sort(F.collect_list("dep_slug")).alias("dependencies"))
    rows = steps.join(sources, ["flow_slug", "step_slug"], "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    parts = [F.col("step_slug").alias("slug"), F.col("step_type").alias("stepType"), F.col("dependencies")]
    if "when_unmet" in steps.columns:
        parts += [F.col("when_unmet").alias("whenUnmet"), F.col("when_exhausted").alias("whenExhausted")]
        parts += [_pattern("required_input_pattern").alias("requiredInputPattern"), _pattern("forbidden_input_pattern").alias("forbiddenInputPattern")]
    # The order is by index alone: a VARIANT in a pattern cannot be compared.
    ordered = F.array_sort(F.collect_list(F.struct("step_index", F.to_json(F.struct(*parts)).alias("s"))))
    return rows.groupBy("flow_slug").agg(F.concat(F.lit('{"steps":['), F.array_join(F.transform(ordered, lambda x: x["s"]), ","), F.lit("]}")).alias("shape"))


def from_shapes(shapes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flows, steps, deps) of shapes given as rows (flow_slug, shape as JSON text).

    Options are not part of a shape: flows get the defaults and steps none; a
    condition's value counts only where it is defined.
    """
    items = F.posexplode(F.try_variant_get(F.parse_json("shape"), "$.steps", "array<variant>")).alias("step_index", "s")
    rows = shapes.select("flow_slug", items)
    get = lambda path, kind="string": F.try_variant_get("s", path, kind)
    pattern = lambda name: F.when(get(f"$.{name}.defined", "boolean"), F.to_json(get(f"$.{name}.value", "variant")))
    named = rows.select(
        "flow_slug", get("$.slug").alias("step_slug"), get("$.stepType").alias("step_type"), "step_index", F.coalesce(get("$.dependencies", "array<string>"), F.array().cast("array<string>")).alias("d"),
        pattern("requiredInputPattern").alias("required_input_pattern"), pattern("forbiddenInputPattern").alias("forbidden_input_pattern"),
        F.coalesce(get("$.whenUnmet"), F.lit("skip")).alias("when_unmet"), F.coalesce(get("$.whenExhausted"), F.lit("fail")).alias("when_exhausted"),
    )
    flows = shapes.select("flow_slug", *[F.lit(DEFAULTS[o]).alias(f"opt_{o}") for o in _OPTIONS[:3]])
    none = {f"opt_{o}": F.lit(None).cast("int") for o in _OPTIONS}
    steps = named.withColumn("deps_count", F.size("d")).withColumns(none).select(*[c.split()[0] for c in STEPS.split(", ")])
    return flows, steps, named.select("flow_slug", F.explode("d").alias("dep_slug"), "step_slug")


def shape_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(step_index, difference) of two step tables (step_index, step_slug, step_type), compared by index."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, "step_index", "full_outer")
    text = (
        F.when(F.col("x.step_slug").isNull(), F.concat(F.lit("missing in first: "), F.col("y.step_slug")))
        .when(F.col("y.step_slug").isNull(), F.concat(F.lit("missing in second: "), F.col("x.step_slug")))
        .when(F.col("x.step_slug") != F.col("y.step_slug"), F.concat_ws(" vs ", "x.step_slug", "y.step_slug"))
        .when(F.col("x.step_type") != F.col("y.step_type"), F.concat_ws(" vs ", "x.step_type", "y.step_type"))
    )
    return both.select("step_index", text.alias("difference")).filter("difference is not null")


def field_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(flow_slug, step_index, field, first, second) of two tables of shapes (flow_slug, shape), by the fields of ``COMPARED``.

    Values are JSON text; a step that one side lacks differs in its slug alone.
    """

    def steps(df: DataFrame, name: str) -> DataFrame:
        items = df.select("flow_slug", F.posexplode(F.try_variant_get(F.parse_json("shape"), "$.steps", "array<variant>")).alias("step_index", "s"))
        values = [F.to_json(F.try_variant_get("s", f"$.{f}", "variant")).alias(f) for f in COMPARED]
        return items.select("flow_slug", "step_index", F.struct(*values).alias(name))

    both = steps(a, "a").join(steps(b, "b"), ["flow_slug", "step_index"], "full_outer")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("first"), F.col(f"b.{f}").alias("second"), (whole | F.lit(f == "slug")).alias("counts")) for f in COMPARED]
    found = both.select("flow_slug", "step_index", F.explode(F.array(*rows)).alias("r")).filter("r.counts and not (r.first <=> r.second)")
    return found.select("flow_slug", "step_index", "r.field", "r.first", "r.second")


def delete_flow(tables: dict[str, DataFrame], flow: str) -> dict[str, DataFrame]:
    """Every table without the rows of a flow."""
    return {name: t.filter(F.col("flow_slug") != flow) for name, t in tables.items()}
