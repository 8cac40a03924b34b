"""Database tables through JDBC, on the embedded database that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from labelforge.sources import readers, sinks

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture()
def url(spark, tmp_path):
    try:
        spark._jvm.java.lang.Class.forName(DRIVER["driver"])
    except Exception:
        pytest.skip("no embedded database on the class path")
    return f"jdbc:derby:{tmp_path}/db;create=true"


def test_events_round_trip_in_ranges(spark, url):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id", "event_type", "value")
    events.write.jdbc(url, "events", properties=DRIVER)
    got = readers.jdbc_table(spark, url, "events", by='"event_id"', parts=4, **DRIVER)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.select(*events.columns).collect())) == sorted(map(tuple, events.collect()))
    pushed = got.filter(F.col("event_id") == 7)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(event_id), *EqualTo(event_id,7)]" in pushed
    events.limit(0).write.jdbc(url, "no_events", properties=DRIVER)
    assert readers.jdbc_table(spark, url, "no_events", by='"event_id"', **DRIVER).collect() == []


def test_unique_keys(spark, url):
    schema, texts = "id long, code long, name string", DRIVER | {"createTableColumnTypes": "name VARCHAR(200)"}
    one = spark.createDataFrame([(1, 10, "ann"), (2, 20, "bob"), (3, 10, "cid"), (4, None, "dan"), (5, None, "eve")], schema)
    assert [(r.id, r.code) for r in sinks.append_unique(one, url, "users", [["code"], ["name"]], **texts).collect()] == [(3, 10)]
    two = spark.createDataFrame([(6, 30, "ann"), (7, 20, "new"), (8, 40, "fay")], schema)
    assert sorted(r.id for r in sinks.append_unique(two, url, "users", [["code"], ["name"]], **texts).collect()) == [6, 7]
    assert sorted(r.id for r in spark.read.jdbc(url, "users", properties=DRIVER).collect()) == [1, 2, 4, 5, 8]
    # The constraint refuses what a writer beside this one would store twice.
    with pytest.raises(Exception):
        two.filter("id = 8").write.mode("append").jdbc(url, "users", properties=DRIVER)
