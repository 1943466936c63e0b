"""Replay in segments: a session's log up to any point is one row that the next segment's row is added to, so a state needs a snapshot and the log since.

A summary is associative: last setters carry their sequence, counts add up, and a field that some events set and others raise is (sequence of the last setter, its value, the
largest raise after it). Segments of a session follow each other by sequence. Live datapoints are rows of their own, as their number has no bound.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.replay import apply_rollback, field, tokens_of

SETTERS = ("behavior_name", "status", "phase", "best_layer", "best_strength", "iteration")
COUNTS = ("llm_calls", "tool_calls", "tokens", "evaluations")
FOLDS = ("progress", "best_score")


class Snapshot(NamedTuple):
    """sessions: session_id, first_sequence, last_sequence, reach (the largest sequence a rollback record names), s (the summary); points: session_id, datapoint_id, sequence, kind."""

    sessions: DataFrame
    points: DataFrame


def _setters() -> dict[str, Column]:
    """The value an event gives to each field; a struct around it tells a null value from none."""
    t, ok = F.col("event_type"), field("success", "boolean")
    ended = t == "session.completed"
    status = F.when(t == "session.started", "running").when(ended, F.when(ok, "completed").otherwise("failed"))
    phase = (
        F.when(t == "session.started", "initializing").when(ended, F.when(ok, "complete").otherwise("failed"))
        .when(t.isin("contrast.pipeline_started", "seed.generation_started"), "generating").when(t == "optimization.started", "extracting").when(t == "evaluation.started", "evaluating")
    )
    layer = F.when(ended | (t == "optimization.aggregation_completed"), field("final_layer", "int")).when(t == "vector.selected", field("layer", "int"))
    iteration = F.when((t == "state.iteration_started") & field("iteration_type").isin("outer", "extraction"), F.coalesce(field("iteration", "int"), F.lit(0)))
    some = lambda where, value: F.when(where, F.struct(F.col("sequence").alias("q"), value.alias("v")))
    own = {"behavior_name": some(t == "session.started", field("behavior_name")), "best_strength": some(t == "vector.selected", field("strength", "double"))}
    for name, value in (("status", status), ("phase", phase), ("best_layer", layer), ("iteration", iteration)):
        own[name] = some(value.isNotNull(), value)
    return own


def _folds() -> dict[str, tuple[Column, Column]]:
    """(value that an event sets, value that it raises to) of each assign-or-raise field."""
    t = F.col("event_type")
    score = F.when(t.isin("session.completed", "optimization.aggregation_completed"), field("final_score", "double")).when(t == "vector.selected", field("score", "double"))
    return {
        "progress": (F.when(t == "contrast.pipeline_started", 0.1).when(t == "contrast.pipeline_completed", 0.4).when(t == "session.completed", 1.0), F.when(t == "optimization.started", 0.4).when(t == "evaluation.started", 0.7).when(t == "evaluation.completed", 0.9)),
        "best_score": (score, F.when(t == "evaluation.completed", F.coalesce(field("scores.overall", "double"), F.lit(0.0)))),
    }


def summarize(events: DataFrame, success_only: bool = True, estimated_tokens: bool = True) -> DataFrame:
    """session_id, first_sequence, last_sequence, s of a segment of the log."""
    t, folds = F.col("event_type"), _folds()
    ran = (t == "optimization.completed") & field("final_loss", "double").isNotNull()
    ran = ran & F.coalesce(field("success", "boolean"), F.lit(False)) if success_only else ran
    loss = F.when(ran, F.struct(field("final_loss", "double").alias("loss"), F.col("sequence").alias("q"), field("layer", "int").alias("layer")))
    rows = events.withColumns({f"_{n}_set": a.cast("double") for n, (a, _) in folds.items()} | {f"_{n}_raise": m.cast("double") for n, (_, m) in folds.items()})
    one = rows.groupBy("session_id").agg(
        F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), *(F.max(c).alias(n) for n, c in _setters().items()),
        F.count_if(t == "llm.response").alias("llm_calls"), F.count_if(t == "tool.result").alias("tool_calls"), F.coalesce(F.sum(F.when(t == "llm.response", tokens_of(estimated_tokens))), F.lit(0)).alias("tokens"),
        F.count_if(t == "evaluation.completed").alias("evaluations"), F.sort_array(F.collect_set(F.when(t == "vector.created", field("layer", "int")))).alias("layers"), F.min(loss).alias("loss"),
        *(F.max(F.when(F.col(f"_{n}_set").isNotNull(), F.struct(F.col("sequence").alias("at"), F.col(f"_{n}_set").alias("base")))).alias(n) for n in FOLDS),
    )
    raises = rows.where(" or ".join(f"_{n}_raise is not null" for n in FOLDS)).select("session_id", "sequence", *(f"_{n}_raise" for n in FOLDS))
    late = raises.join(one.select("session_id", *(F.col(f"{n}.at").alias(f"_{n}_at") for n in FOLDS)), "session_id")
    since = lambda n: F.col(f"_{n}_at").isNull() | (F.col("sequence") > F.col(f"_{n}_at"))
    tops = late.groupBy("session_id").agg(*(F.max(F.when(since(n), F.col(f"_{n}_raise"))).alias(f"_{n}_top") for n in FOLDS))
    fold = lambda n: F.struct(F.col(f"{n}.at").alias("at"), F.col(f"{n}.base").alias("base"), F.col(f"_{n}_top").alias("top")).alias(n)
    s = F.struct(*SETTERS, *COUNTS, "layers", "loss", *(fold(n) for n in FOLDS))
    return one.join(tops, "session_id", "left").select("session_id", "first_sequence", "last_sequence", s.alias("s"))


def merge(a: Column, b: Column) -> Column:
    """The summary of two segments, the second behind the first. Associative, with a segment of no events as neutral."""

    def fold(n: str) -> Column:
        x, y = a[n], b[n]
        anew = y["at"].isNotNull()
        pick = lambda f, other: F.when(anew, y[f]).otherwise(other)
        return F.struct(pick("at", x["at"]).alias("at"), pick("base", x["base"]).alias("base"), pick("top", F.greatest(x["top"], y["top"])).alias("top")).alias(n)

    return F.struct(
        *(F.greatest(a[n], b[n]).alias(n) for n in SETTERS), *((a[n] + b[n]).alias(n) for n in COUNTS), F.sort_array(F.array_union(a["layers"], b["layers"])).alias("layers"),
        F.least(a["loss"], b["loss"]).alias("loss"), *(fold(n) for n in FOLDS),
    )


def merge_segments(segments: DataFrame) -> DataFrame:
    """One row per session of the summaries of its segments, whose number a session is bounded by how often snapshots are taken."""
    rows = segments.groupBy("session_id").agg(
        F.min("first_sequence").alias("first_sequence"), F.max("last_sequence").alias("last_sequence"), F.max("reach").alias("reach"), F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("first_sequence", "s")))).alias("parts")
    )
    summaries = F.transform("parts", lambda p: p["s"])
    whole = F.when(F.size("parts") > 0, F.aggregate(F.slice(summaries, F.lit(2), F.size("parts")), F.get(summaries, F.lit(0)), merge))
    return rows.select("session_id", "first_sequence", "last_sequence", "reach", whole.alias("s"))


def _points(events: DataFrame) -> DataFrame:
    rows = events.where("event_type in ('datapoint.added', 'datapoint.removed')").groupBy("session_id", field("datapoint_id").alias("datapoint_id"))
    return rows.agg(F.max("sequence").alias("sequence"), F.max_by("event_type", "sequence").alias("kind"))


def take_snapshot(events: DataFrame, honor: bool = False, success_only: bool = True, estimated_tokens: bool = True) -> Snapshot:
    """Of a log from its start, with its rollback records applied (see apply_rollback)."""
    mark = F.when(F.col("event_type") == "checkpoint.rollback", F.coalesce(field("previous_sequence", "long"), F.lit(0)))
    span = events.groupBy("session_id").agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.max(mark).alias("reach"))
    kept = apply_rollback(events, honor)
    # a session all of whose events are undone stays known, without a summary
    sessions = span.join(summarize(kept, success_only, estimated_tokens).select("session_id", "s"), "session_id", "left")
    return Snapshot(sessions.select("session_id", "first_sequence", "last_sequence", "reach", "s"), _points(kept))


def stale_sessions(snapshot: Snapshot, tail: DataFrame) -> DataFrame:
    """session_id of sessions whose tail holds a rollback record that reaches back into the snapshot: honouring it takes their whole log."""
    records = tail.where("event_type = 'checkpoint.rollback'").select("session_id", "sequence", F.coalesce(field("previous_sequence", "long"), F.lit(0)).alias("to"))
    last = snapshot.sessions.select("session_id", "last_sequence")
    return records.join(last, "session_id").where("sequence > last_sequence and to < last_sequence").select("session_id").distinct()


def resume(snapshot: Snapshot, tail: DataFrame, honor: bool = False, history: DataFrame | None = None, success_only: bool = True, estimated_tokens: bool = True) -> Snapshot:
    """The snapshot after the tail, as take_snapshot of the whole log gives it. Of the tail only what lies behind a session's snapshot counts, so what is read twice
    does no harm; sessions without a snapshot start with their tail. honor: the whole log (history, the tail included) is read for stale sessions, and needed for those only."""
    if honor and history is None:
        raise ValueError("honoured rollbacks may reach back into the snapshot: give the whole log as history")
    known = snapshot.sessions.select("session_id", F.col("last_sequence").alias("_last"), F.col("reach").alias("_reach"))
    new = tail.join(known, "session_id", "left").where("_last is null or sequence > _last")
    if honor:
        stale = stale_sessions(snapshot, tail)
        new = new.drop("_last", "_reach").join(stale, "session_id", "left_anti")
        whole = take_snapshot(history.join(stale, "session_id", "left_semi"), True, success_only, estimated_tokens)
        snapshot = Snapshot(snapshot.sessions.join(stale, "session_id", "left_anti").unionByName(whole.sessions), snapshot.points.join(stale, "session_id", "left_anti").unionByName(whole.points))
    else:  # records before the tail may name sequences in it
        new = new.where("_reach is null or sequence > _reach or event_type = 'checkpoint.rollback'").drop("_last", "_reach")
    more = take_snapshot(new, honor, success_only, estimated_tokens)
    points = snapshot.points.unionByName(more.points).groupBy("session_id", "datapoint_id").agg(F.max("sequence").alias("sequence"), F.max_by("kind", "sequence").alias("kind"))
    return Snapshot(merge_segments(snapshot.sessions.unionByName(more.sessions)), points)


def state(snapshot: Snapshot) -> DataFrame:
    """The columns of replay_state."""
    live = snapshot.points.where("kind = 'datapoint.added'").groupBy("session_id").agg(F.count("*").alias("datapoints"))
    v = lambda n, default=None: (F.coalesce(F.col(f"s.{n}.v"), F.lit(default)) if default is not None else F.col(f"s.{n}.v")).alias(n)
    folded = lambda n: F.greatest(F.coalesce(f"s.{n}.base", F.lit(0.0)), F.coalesce(f"s.{n}.top", F.coalesce(f"s.{n}.base", F.lit(0.0)))).alias(n)
    return snapshot.sessions.where("s is not null").join(live, "session_id", "left").select(
        "session_id", v("behavior_name", ""), v("status", ""), v("phase", ""), v("best_layer"), v("best_strength", 1.0), v("iteration", 0), "s.llm_calls", "s.tool_calls", "s.tokens", F.size("s.layers").cast("long").alias("vectors"), "s.evaluations",
        folded("progress"), folded("best_score"), F.col("s.loss.loss").alias("best_loss"), F.col("s.loss.layer").alias("best_loss_layer"), F.coalesce("datapoints", F.lit(0)).alias("datapoints"),
    )


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """A new folder for each snapshot: one that is read while another is written stays whole."""
    snapshot.sessions.write.parquet(f"{path}/sessions")
    snapshot.points.write.parquet(f"{path}/points")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    return Snapshot(spark.read.parquet(f"{path}/sessions"), spark.read.parquet(f"{path}/points"))
