import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from loomspark.functions import scalars as S
from loomspark.plans.containment import contains, contains_value
from loomspark.plans.flow import Flow, FlowRegistry, compare_shapes, compile_flow, shape


def base():
    return Flow("f").step("a", None).step("b", None, ["a"], if_={"a": {"x": 1}}).map("c", None, "a")


@pytest.mark.parametrize("bad", ["", "run", "1a", "a-b", "a\n", "x" * 129])
def test_bad_slugs(bad, spark):
    with pytest.raises(ValueError):
        Flow(bad)
    assert spark.createDataFrame([(bad,)], "s string").select(S.valid_slug(F.col("s"))).first()[0] is False


def test_builder_rules():
    f = base()
    assert len(f.steps) == 3 and f.step("d", None) is not f and len(f.steps) == 3
    for call in (lambda: f.step("a", None), lambda: f.step("z", None, ["nope"]), lambda: f.step("z", None, max_attempts=0), lambda: f.step("z", None, timeout=2), lambda: f.step("z", None, when_unmet="x"), lambda: f.step("z", None, if_=[1]), lambda: Flow("g", {"start_delay": 1})):
        with pytest.raises(ValueError):
            call()
    assert [s.slug for s in f.leaves()] == ["b", "c"] and [[s.slug for s in w] for w in f.waves()] == [["a"], ["b", "c"]]


def test_compile_and_shape():
    sql = compile_flow(Flow("f", {"timeout": 9}).step("a", None, start_delay=4).map("m", None, "a", if_not={"a": {"n": "it's"}}, when_exhausted="skip"))
    assert sql[0] == "SELECT create_flow('f', timeout => 9);"
    assert sql[1] == "SELECT add_step('f', 'a', start_delay => 4);"
    assert "step_type => 'map'" in sql[2] and "it''s" in sql[2] and "when_exhausted => 'skip'" in sql[2]
    assert compare_shapes(shape(base()), shape(base())) == []
    assert len(compare_shapes(shape(base()), shape(Flow("f").step("a", None)))) == 3


def test_registry():
    r = FlowRegistry(base())
    with pytest.raises(ValueError):
        r.add(base())
    assert [r.ensure_compiled(x, y)["status"] for x, y in ((base(), False), (base(), False), (base().step("d", None), False), (base().step("d", None), True))] == ["compiled", "verified", "mismatch", "recompiled"]
    assert r.get("f")["sql"][0].startswith("SELECT create_flow")


def random_value(r, depth=0):
    kinds = [lambda: r.randint(0, 3), lambda: r.choice(["1", "a", "b"]), lambda: r.choice([True, False]), lambda: None, lambda: r.choice([1.0, 1.5])]
    if depth < 3:
        kinds += [lambda: {k: random_value(r, depth + 1) for k in r.sample("abc", r.randint(0, 3))}, lambda: [random_value(r, depth + 1) for _ in range(r.randint(0, 3))]] * 2
    return r.choice(kinds)()


def test_containment_equals_python(spark):
    r = random.Random(3)
    values = [random_value(r) for _ in range(150)]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, j string").withColumn("v", F.parse_json("j"))
    patterns = [p for p in (random_value(r) for _ in range(60)) if isinstance(p, dict)][:14] + [{"a": {}}, {"a": None}, {"a": [1]}, {"a": 1}, {"a": "1"}]
    got = df.select("k", *[contains(F.col("v"), VariantType(), p).alias(f"p{n}") for n, p in enumerate(patterns)]).collect()
    for row in got:
        for n, p in enumerate(patterns):
            assert row[f"p{n}"] == contains_value(values[row.k], p), (values[row.k], p)


def test_retry_delays(spark):
    got = spark.range(1, 4).select(S.retry_delay(F.lit(5), F.col("id")), S.message_retry_delay(F.lit(3), F.col("id"), 7)).collect()
    assert [tuple(r) for r in got] == [(10, 3), (20, 6), (40, 7)]
