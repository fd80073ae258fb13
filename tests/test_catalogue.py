"""Every query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

from loomspark.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    cursor = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    mine = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in cursor.fetchall())
    assert mine == theirs


def test_distribution_counts_every_event(spark):
    counted = catalogue.QUERIES["per_second_distribution_whole"](spark, D).agg({"n": "sum"}).collect()[0][0]
    assert counted == spark.read.parquet(f"{D}/events.parquet").count()


def test_queue_queries_take_whole_queues(spark):
    events = spark.read.parquet(f"{D}/events.parquet")
    assert catalogue.QUERIES["enqueue_batch_whole"](spark, D).count() == 2 * events.count()
    read = catalogue.QUERIES["visible_read_whole"](spark, D).join(events.withColumnRenamed("event_id", "msg_id"), "msg_id")
    assert {r[0] for r in read.selectExpr("user_id % 2").distinct().collect()} == {0, 1}
    assert read.filter("ts > timestamp_ntz'2024-01-15 12:00:00'").isEmpty()


def test_entry():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
