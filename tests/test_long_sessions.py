"""Pieces of long sessions against plain windows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.operators import replay as r
from contrail.sources import events as src


@pytest.fixture(scope="module")
def rows(spark):
    """One session with nine tenths of the events, gaps in the sequence, a null session."""
    df = spark.range(2000).selectExpr("if(id % 10 = 3, if(id % 20 = 3, null, 'small'), 'large') as s", "id * 3 + id div 500 * 700 as q", "id % 7 as k", "id as v")
    return df.repartition(5).cache()


@pytest.mark.parametrize("piece", [1, 50, 10**9])
def test_pieces_are_windows(rows, piece):
    by, null = Window.partitionBy("s", "k").orderBy("q"), F.col("s").isNotNull()
    want = sorted(map(tuple, rows.where(null).withColumn("p", F.lag("v").over(by)).collect()), key=repr)
    assert sorted(map(tuple, r.with_previous(rows.where(null), ["s", "k"], "q", F.col("v"), "p", piece).collect()), key=repr) == want
    by = Window.partitionBy("s").orderBy("q")
    want = sorted(map(tuple, rows.withColumn("n", F.row_number().over(by)).collect()), key=repr)
    assert sorted(map(tuple, r.numbered(rows, "s", "q", "n", piece).collect()), key=repr) == want
    down = Window.partitionBy("s").orderBy(F.col("q").desc())
    for n in (1, 37, 5000):
        want = sorted(map(tuple, rows.withColumn("n", F.row_number().over(down)).where(F.col("n") <= n).drop("n").collect()), key=repr)
        assert sorted(map(tuple, r.last_rows(rows, "s", "q", n, piece).collect()), key=repr) == want


def test_a_long_session_is_dealt_to_many_tasks(spark, rows):
    """All work on rows runs by pieces: no task has more than a few of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = r.numbered(rows, "s", "q", "n", 100)
        most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert out.where("s = 'large'").count() == 1800 and most < 1100
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_calls_without_an_id_dont_pair(spark):
    events = spark.createDataFrame(
        [("s", i, None, "llm.request" if i % 2 else "llm.response", "x", body) for i, body in enumerate(["{}", "{}", "{}", '{"request_id": "a", "model": "m"}', '{"request_id": "a", "usage": {"total_tokens": 3}}', "{}"], 0)]
        + [(None, 1, None, "llm.request", "x", '{"request_id": "a"}'), (None, 2, None, "llm.response", "x", '{"request_id": "a", "usage": {"total_tokens": 5}}')],
        "session_id string, sequence long, timestamp timestamp, event_type string, source string, payload string",
    )
    assert [(x["first_sequence"], x["second_sequence"]) for x in r.pair_llm_calls(events).collect()] == [(3, 4)]
    usage = {(x["session_id"], x["model"]): (x["calls"], x["tokens"]) for x in r.token_usage(events, ("session_id", "model")).collect()}
    assert usage == {("s", "m"): (1, 3), ("s", None): (2, 0), (None, None): (1, 5)}


def test_numbers_go_on_behind_the_existing(spark):
    new = spark.createDataFrame([("a", i, "llm.request") for i in (5, 70_000, 200_000)] + [("b", 1, "odd")], "session_id string, pos long, event_type string")
    old = spark.createDataFrame([("a", 9)], "session_id string, sequence long")
    got = sorted((x["session_id"], x["pos"], x["sequence"], x["category"]) for x in src.next_sequences(new, old).collect())
    assert got == [("a", 5, 10, "llm"), ("a", 70_000, 11, "llm"), ("a", 200_000, 12, "llm"), ("b", 1, 1, "state")]
