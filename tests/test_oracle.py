"""Every query that SQL can express, against that SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from halyard.plans import library

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(x) + 0.0 if isinstance(plain(x), float) else plain(x) for x in r)) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(library.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = library.QUERIES[name](spark, DATA).toPandas(), duck.sql(library.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLE_SQL)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, DATA).count() > 0


def test_every_row_is_taken(spark):
    """Queries without SQL, against the tables they read."""
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    run = lambda name: library.QUERIES[name](spark, DATA).collect()
    assert sorted(r["uri"] for r in run("stream_index")) == sorted(f"part/{r['p_partkey']}" for r in read("part").collect())
    assert {r["media_id"] for r in run("stream_queue")} == {r["user_id"] for r in read("events").collect()}
    assert sorted(r["vec_id"] for r in run("image_preprocess")) == sorted(r["vec_id"] for r in read("embeddings").collect())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown_and_pruning(spark):
    from halyard.operators.catalog import newer_than

    events = spark.read.parquet(f"{DATA}/events.parquet").withColumnRenamed("ts", "date_added")
    cast = events.select("event_id", events["date_added"].cast("timestamp").alias("date_added"))
    plan = cast.filter(newer_than(1_704_844_800_456))._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan and "props" not in plan
