"""Replay from a snapshot and a tail against replay of the whole log."""

import json
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from contrail.operators import replay as r
from contrail.operators import snapshots as sn
from contrail.queries.events import QUERIES

SCHEMA = "event_id string, session_id string, timestamp timestamp, sequence long, category string, event_type string, source string, payload string"
CUTS = 20


def random_log(seed, sessions=4, length=60, rollbacks=True):
    rng = random.Random(seed)
    make = {
        "session.started": lambda: {"behavior_name": f"b{rng.randrange(3)}"}, "session.completed": lambda: {"success": rng.random() < 0.5, "final_score": rng.choice([None, 0.3, 0.8]), "final_layer": rng.choice([None, 3])},
        "contrast.pipeline_started": dict, "contrast.pipeline_completed": dict, "optimization.started": dict, "evaluation.started": dict, "tool.result": dict, "llm.response": lambda: {"usage": {"total_tokens": rng.randrange(9), "estimated_tokens": 2}},
        "evaluation.completed": lambda: {"scores": {"overall": rng.random()}} if rng.random() < 0.8 else {}, "vector.created": lambda: {"layer": rng.choice([1, 2, None])}, "vector.selected": lambda: {"layer": rng.choice([4, None]), "strength": rng.choice([None, 2.0]), "score": rng.choice([None, 0.5])},
        "optimization.completed": lambda: {"final_loss": rng.choice([None, 0.1, 0.2]), "layer": rng.randrange(5), "success": rng.random() < 0.6}, "datapoint.added": lambda: {"datapoint_id": f"d{rng.randrange(5)}"}, "datapoint.removed": lambda: {"datapoint_id": f"d{rng.randrange(5)}"},
        "state.iteration_started": lambda: {"iteration_type": rng.choice(["outer", "inner"]), "iteration": rng.randrange(9)}, "optimization.aggregation_completed": lambda: {"final_score": rng.choice([None, 0.6]), "final_layer": 6},
    }
    out = []
    for s in range(sessions):
        for q in range(1, length):
            kind = rng.choice(list(make))
            body = make[kind]()
            if rollbacks and rng.random() < 0.08:
                kind, body = "checkpoint.rollback", {"previous_sequence": rng.choice([max(0, q - rng.randrange(1, 9)), q + 3, None])}
            out.append((f"{s}", q, kind, json.dumps(body)))
    return out


def every_cut(spark, log):
    """The log once for each cut, with the cut as a column: all cuts in one job."""
    rows = spark.createDataFrame([("e", s, None, q, kind.split(".")[0], kind, "", body) for s, q, kind, body in log], SCHEMA)
    copies = rows.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1)))).withColumn("session_id", F.concat("session_id", F.lit("/"), "cut"))
    return copies.withColumn("head", F.col("sequence") <= F.col("cut") * 3)


def rows(df):
    return sorted((tuple(x[c] for c in sorted(df.columns)) for x in df.collect()), key=repr)


@pytest.mark.parametrize("honor,seed", [(False, 1), (True, 2), (True, 3)])
def test_snapshot_and_tail_are_the_whole_log(spark, tmp_path, honor, seed):
    log = every_cut(spark, random_log(seed))
    events = log.drop("cut", "head")
    sn.write_snapshot(sn.take_snapshot(log.where("head").drop("cut", "head"), honor), str(tmp_path / "snapshot"))
    # a part of what the snapshot holds comes again
    tail = log.where("not head or sequence % 4 = 0").drop("cut", "head")
    got = sn.state(sn.resume(sn.read_snapshot(spark, str(tmp_path / "snapshot")), tail, honor, events))
    want = r.replay_state(r.apply_rollback(events, honor))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(rows(want)) == 4 * CUTS


def test_merging_is_associative(spark):
    log = every_cut(spark, random_log(9, rollbacks=False)).withColumn("part", (F.col("sequence") / 7).cast("int"))
    parts = [sn.summarize(log.where(p).drop("cut", "head", "part")) for p in ("part < 3", "part between 3 and 5", "part > 5")]
    a, b, c = (p.select("session_id", F.col("s").alias(n)) for p, n in zip(parts, "abc"))
    both = a.join(b, "session_id").join(c, "session_id")
    left, right = sn.merge(sn.merge(F.col("a"), F.col("b")), F.col("c")), sn.merge(F.col("a"), sn.merge(F.col("b"), F.col("c")))
    assert both.where(~left.eqNullSafe(right)).count() == 0 and both.count() == 4 * CUTS
    whole = sn.summarize(log.drop("cut", "head", "part")).select("session_id", "s")
    assert both.select("session_id", left.alias("m")).join(whole, "session_id").where(~F.col("m").eqNullSafe(F.col("s"))).count() == 0


def test_snapshots_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([("e", "s", None, 1, "session", "session.started", "", json.dumps({"behavior_name": "b"}))], SCHEMA)
    assert sn.state(sn.take_snapshot(none)).collect() == []
    assert rows(sn.state(sn.resume(sn.take_snapshot(none), some))) == rows(r.replay_state(some)) == rows(sn.state(sn.resume(sn.take_snapshot(some), none)))


def test_honoured_rollbacks_need_the_history(spark):
    none = sn.take_snapshot(spark.createDataFrame([], SCHEMA))
    with pytest.raises(ValueError, match="history"):
        sn.resume(none, spark.createDataFrame([], SCHEMA), honor=True)


@pytest.mark.parametrize("name", ["h1_replay_from_snapshot", "h3_replay_from_snapshot_honored"])
def test_queries_read_a_stored_log(spark, name):
    """The log is derived from the events once; the state reads what was written."""
    assert not [f for f in QUERIES[name](spark, SMALL).inputFiles() if "events.parquet" in f]
