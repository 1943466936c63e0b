"""Event logs to state: pairing, replay by aggregates instead of loops, statistics and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def field(path: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{path}").cast(kind)


#: Sequences of one piece of a session: pieces of a long session are worked on by different tasks.
PIECE = 65_536


def with_previous(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, piece: int = PIECE) -> DataFrame:
    """rows with the value of the row before in the key, by a whole-number order; a key's rows are dealt by pieces of the order.

    Inside a piece a window tells. A piece's first row, which finds nothing there, gets the last value of the piece before: one row for each piece, itself a window of
    as many rows as a key has pieces."""
    cut = rows.withColumn("_piece", F.floor(F.col(order) / piece)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_piece").orderBy(order)
    lagged = cut.withColumn(name, F.lag("_value").over(inside)).withColumn("_at", F.row_number().over(inside))
    last = cut.groupBy(*keys, "_piece").agg(F.max_by("_value", order).alias("_last"))
    carried = last.select(*keys, "_piece", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_carried")).where("_carried is not null")
    first = lagged.where("_at = 1").join(carried, [*keys, "_piece"], "left").withColumn(name, F.col("_carried")).drop("_carried")
    return lagged.where("_at > 1").unionByName(first).drop("_piece", "_value", "_at")


def last_rows(rows: DataFrame, key: str, order: str, n: int, piece: int = PIECE) -> DataFrame:
    """The n rows of each key with the largest order (a unique whole number). Counts of pieces tell which piece the cut falls in; only its rows are ranked."""
    cut = rows.withColumn("_piece", F.floor(F.col(order) / piece))
    counts = cut.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    later = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # per piece: how many of its rows are still wanted
    wanted = counts.withColumn("_left", F.lit(n) - later).where("_left > 0").select(F.col(key).alias("_key"), F.col("_piece").alias("_p"), "_left", (F.col("_n") <= F.col("_left")).alias("_whole"))
    met = cut.join(wanted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_p")))
    ranked = met.where("not _whole").withColumn("_r", F.row_number().over(Window.partitionBy("_key", "_p").orderBy(F.col(order).desc()))).where("_r <= _left")
    return met.where("_whole").select(*rows.columns).unionByName(ranked.select(*rows.columns))


def numbered(rows: DataFrame, key: str, order: str, name: str, piece: int = PIECE) -> DataFrame:
    """rows with their number in the key from 1, by a unique whole-number order: numbers inside pieces, offset by the counts of the pieces before."""
    cut = rows.withColumn("_piece", F.floor(F.col(order) / piece))
    counts = cut.groupBy(key, "_piece").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("_key"), F.col("_piece").alias("_p"), before.alias("_before"))
    inside = cut.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_piece").orderBy(order)))
    met = inside.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_p")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_in")).cast("long").alias(name))


def _after(events: DataFrame, first: str, second: str, key: str, bring: dict[str, Column], piece: int = PIECE) -> DataFrame:
    """The events of the second kind with _key and _before: what the first kind's event brings, if it is the last one of their id before it (else null)."""
    rows = events.where(F.col("event_type").isin(first, second)).withColumn("_key", field(key))
    rows = rows.where(F.col("_key").isNotNull() & F.col("session_id").isNotNull())
    rows = with_previous(rows, ["session_id", "_key"], "sequence", F.struct("event_type", "sequence", "timestamp", *(c.alias(n) for n, c in bring.items())), "_before", piece)
    return rows.where(F.col("event_type") == second).withColumn("_before", F.when(F.col("_before.event_type") == first, F.col("_before")))


def _pair(events: DataFrame, first: str, second: str, key: str, keep: dict[str, Column], bring: dict[str, Column]) -> DataFrame:
    rows = _after(events, first, second, key, bring).where("_before is not null")
    return rows.select(
        "session_id",
        F.col("_key").alias(key),
        F.col("_before.sequence").alias("first_sequence"),
        F.col("sequence").alias("second_sequence"),
        ((F.unix_micros("timestamp") - F.unix_micros(F.col("_before.timestamp"))) / 1e6).alias("seconds"),
        *(F.col(f"_before.{n}").alias(n) for n in bring),
        *(c.alias(n) for n, c in keep.items()),
    )


def tokens_of(estimated: bool = False) -> Column:
    """Tokens of a response; no usage: 0."""
    own = F.coalesce(field("usage.total_tokens", "long"), F.lit(0))
    return own + F.coalesce(field("usage.estimated_tokens", "long"), F.lit(0)) if estimated else own


def pair_llm_calls(events: DataFrame) -> DataFrame:
    """Each response with the latest earlier request of its id that no other response came after; the rest goes, calls without a session or id too."""
    return _pair(events, "llm.request", "llm.response", "request_id", {"tokens": tokens_of()}, {"model": field("model")})


def pair_tool_calls(events: DataFrame) -> DataFrame:
    return _pair(events, "tool.call", "tool.result", "call_id", {"success": F.coalesce(field("success", "boolean"), F.lit(True))}, {"tool_name": field("tool_name")})


def _latest_after(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left(session_id, key, sequence) with the last row of right(session_id, key, _seq, v) of a larger sequence."""
    after = left.join(right, ["session_id", key]).where("_seq > sequence")
    last = after.groupBy("session_id", key).agg(F.max_by("v", "_seq").alias("v"))
    return left.join(last, ["session_id", key], "left")


def replay_pairs(events: DataFrame) -> DataFrame:
    """session_id, pair_id, sequence, is_valid, contrast_quality: the last generation of each pair with the last validation after it."""
    made = events.where("event_type = 'contrast.pair_generated'").groupBy("session_id", field("pair_id").alias("pair_id")).agg(F.max("sequence").alias("sequence"))
    v = F.struct(F.coalesce(field("is_valid", "boolean"), F.lit(False)).alias("is_valid"), F.coalesce(field("contrast_quality", "double"), F.lit(0.0)).alias("contrast_quality"))
    checks = events.where("event_type = 'contrast.pair_validated'").select("session_id", field("pair_id").alias("pair_id"), F.col("sequence").alias("_seq"), v.alias("v"))
    out = _latest_after(made, checks, "pair_id")
    return out.select("session_id", "pair_id", "sequence", F.coalesce("v.is_valid", F.lit(False)).alias("is_valid"), F.coalesce("v.contrast_quality", F.lit(0.0)).alias("contrast_quality"))


def replay_datapoints(events: DataFrame) -> DataFrame:
    """session_id, datapoint_id, sequence, recommendation of datapoints whose last event is an addition, with the last quality event after it."""
    rows = events.where("event_type in ('datapoint.added', 'datapoint.removed')").groupBy("session_id", field("datapoint_id").alias("datapoint_id"))
    live = rows.agg(F.max_by("event_type", "sequence").alias("last"), F.max("sequence").alias("sequence")).where("last = 'datapoint.added'").drop("last")
    quality = events.where("event_type = 'datapoint.quality'").select("session_id", field("datapoint_id").alias("datapoint_id"), F.col("sequence").alias("_seq"), field("recommendation").alias("v"))
    return _latest_after(live, quality, "datapoint_id").withColumnRenamed("v", "recommendation")


def assign_or_max(events: DataFrame, assign: Column, larger: Column, name: str, initial: float = 0.0) -> DataFrame:
    """session_id, name: a fold in which some events set a value and others raise it to theirs: the value of the last setter, or the
    largest raise after it."""
    rows = events.select("session_id", "sequence", assign.cast("double").alias("a"), larger.cast("double").alias("m"))
    last = rows.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("a").isNotNull(), F.col("sequence"))), F.lit(-1)).alias("at"), F.max_by("a", F.when(F.col("a").isNotNull(), F.col("sequence"))).alias("base"))
    after = rows.join(last, "session_id").groupBy("session_id").agg(F.max(F.when(F.col("sequence") > F.col("at"), F.col("m"))).alias("top"), F.first("base").alias("base"))
    base = F.coalesce("base", F.lit(float(initial)))
    return after.select("session_id", F.greatest(base, F.coalesce("top", base)).alias(name))


def apply_rollback(events: DataFrame, honor: bool = False) -> DataFrame:
    """Without honor nothing but the rollback records goes (an event is dropped only if it comes after a record that names a later
    sequence). With honor, events after a record's previous_sequence and before the record go."""
    mark = F.when(F.col("event_type") == "checkpoint.rollback", F.coalesce(field("previous_sequence", "long"), F.lit(0)))
    session = Window.partitionBy("session_id").orderBy("sequence")
    if honor:  # some later record reaches back before the event
        reach = F.min(mark).over(session.rowsBetween(1, Window.unboundedFollowing))
        gone = F.coalesce(reach < F.col("sequence"), F.lit(False))
    else:  # some earlier record names a sequence not before the event's
        reach = F.max(mark).over(session.rowsBetween(Window.unboundedPreceding, -1))
        gone = F.coalesce(reach >= F.col("sequence"), F.lit(False))
    return events.withColumn("_gone", gone).where("event_type <> 'checkpoint.rollback' and not _gone").drop("_gone")


def _last(value: Column, where: Column) -> Column:
    return F.max_by(value, F.when(where, F.col("sequence")))


def replay_state(events: DataFrame, up_to_sequence: int | None = None, success_only: bool = True, estimated_tokens: bool = True) -> DataFrame:
    """One row per session: behaviour, status, phase, progress, best layer, strength and score, best loss by layer, counts.

    Every field is an aggregate over the log: the last setter's value, or an assign-or-raise fold. A null score of vector.selected is
    ignored. best_loss and best_loss_layer come from optimization results (successful ones by default), beside best_score.
    """
    if up_to_sequence is not None:
        events = events.where(F.col("sequence") <= up_to_sequence)
    t = F.col("event_type")
    ok = field("success", "boolean")
    status = F.when(t == "session.started", "running").when(t == "session.completed", F.when(ok, "completed").otherwise("failed"))
    phase = (
        F.when(t == "session.started", "initializing").when(t == "session.completed", F.when(ok, "complete").otherwise("failed"))
        .when(t.isin("contrast.pipeline_started", "seed.generation_started"), "generating").when(t == "optimization.started", "extracting").when(t == "evaluation.started", "evaluating")
    )
    layer = F.when(t == "session.completed", field("final_layer", "int")).when(t == "vector.selected", field("layer", "int")).when(t == "optimization.aggregation_completed", field("final_layer", "int"))
    iteration = F.when((t == "state.iteration_started") & field("iteration_type").isin("outer", "extraction"), F.coalesce(field("iteration", "int"), F.lit(0)))
    out = events.groupBy("session_id").agg(
        F.coalesce(_last(field("behavior_name"), t == "session.started"), F.lit("")).alias("behavior_name"),
        F.coalesce(_last(status, status.isNotNull()), F.lit("")).alias("status"),
        F.coalesce(_last(phase, phase.isNotNull()), F.lit("")).alias("phase"),
        _last(layer, layer.isNotNull()).alias("best_layer"),
        F.coalesce(_last(field("strength", "double"), t == "vector.selected"), F.lit(1.0)).alias("best_strength"),
        F.coalesce(_last(iteration, iteration.isNotNull()), F.lit(0)).alias("iteration"),
        F.count_if(t == "llm.response").alias("llm_calls"),
        F.count_if(t == "tool.result").alias("tool_calls"),
        F.coalesce(F.sum(F.when(t == "llm.response", tokens_of(estimated_tokens))), F.lit(0)).alias("tokens"),
        F.countDistinct(F.when(t == "vector.created", field("layer", "int"))).alias("vectors"),
        F.count_if(t == "evaluation.completed").alias("evaluations"),
    )
    progress = assign_or_max(
        events,
        F.when(t == "contrast.pipeline_started", 0.1).when(t == "contrast.pipeline_completed", 0.4).when(t == "session.completed", 1.0),
        F.when(t == "optimization.started", 0.4).when(t == "evaluation.started", 0.7).when(t == "evaluation.completed", 0.9),
        "progress",
    )
    score = assign_or_max(
        events,
        F.when(t == "session.completed", field("final_score", "double")).when(t.isin("vector.selected"), field("score", "double")).when(t == "optimization.aggregation_completed", field("final_score", "double")),
        F.when(t == "evaluation.completed", F.coalesce(field("scores.overall", "double"), F.lit(0.0))),
        "best_score",
    )
    runs = events.where((t == "optimization.completed") & field("final_loss", "double").isNotNull())
    runs = runs.where(ok) if success_only else runs
    loss = runs.groupBy("session_id").agg(F.min(field("final_loss", "double")).alias("best_loss"), F.min_by(field("layer", "int"), F.struct(field("final_loss", "double"), F.col("sequence"))).alias("best_loss_layer"))
    points = replay_datapoints(events).groupBy("session_id").agg(F.count("*").alias("datapoints"))
    for part in (progress, score, loss, points):
        out = out.join(part, "session_id", "left")
    return out.withColumn("datapoints", F.coalesce("datapoints", F.lit(0)))


def replay_vectors(events: DataFrame) -> DataFrame:
    """session_id, layer, vector_id, sequence: the last vector of each layer."""
    rows = events.where("event_type = 'vector.created'").groupBy("session_id", field("layer", "int").alias("layer"))
    return rows.agg(F.max_by(field("vector_id"), "sequence").alias("vector_id"), F.max("sequence").alias("sequence"))


def replay_seed_assignments(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'seed.assigned'").groupBy("session_id", F.coalesce(field("sample_idx", "int"), F.lit(0)).alias("sample_idx"))
    zero = lambda c: F.coalesce(field(c, "int"), F.lit(0))
    return rows.agg(F.max_by(zero("num_core_seeds"), "sequence").alias("core"), F.max_by(zero("num_unique_seeds"), "sequence").alias("unique"))


def replay_seeds(events: DataFrame) -> DataFrame:
    """session_id, seed_id, scenario, context, quality_score, is_core: the last generation of each seed."""
    rows = events.where("event_type = 'seed.generated'").groupBy("session_id", field("seed_id").alias("seed_id"))
    seed = F.struct(field("scenario").alias("scenario"), field("context").alias("context"), field("quality_score", "double").alias("quality_score"), field("is_core", "boolean").alias("is_core"))
    return rows.agg(F.max_by(seed, "sequence").alias("s")).select("session_id", "seed_id", "s.*")


def replay_optimizations(events: DataFrame) -> DataFrame:
    """session_id, sequence and the result of each optimization, in the order of the log; none replaces another."""
    kinds = {"sample_idx": "int", "layer": "int", "final_loss": "double", "iterations": "int", "datapoints_used": "int", "duration_seconds": "double", "success": "boolean", "error": "string"}
    return events.where("event_type = 'optimization.completed'").select("session_id", "sequence", *(field(k, t).alias(k) for k, t in kinds.items()))


def replay_evaluations(events: DataFrame) -> DataFrame:
    """session_id, sequence and the result of each evaluation, in the order of the log; absent fields get their defaults."""
    rows = events.where("event_type = 'evaluation.completed'")
    default = lambda k, kind, value: F.coalesce(field(k, kind), F.lit(value)).alias(k)
    return rows.select(
        "session_id", "sequence", default("evaluation_id", "string", ""), default("eval_type", "string", "quick"), F.coalesce(field("scores.overall", "double"), F.lit(0.0)).alias("overall"),
        default("verdict", "string", "needs_refinement"), default("recommended_strength", "double", 1.0),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """session_id, event_type, n; a null event_type is the session's total, both null the log's."""
    return events.rollup("session_id", "event_type").agg(F.count("*").alias("n"))


def session_summary(events: DataFrame) -> DataFrame:
    t = F.col("event_type")
    return events.groupBy("session_id").agg(
        F.count_if(t == "llm.response").alias("llm_calls"), F.count_if(t == "tool.result").alias("tool_calls"), F.count_if(t == "datapoint.added").alias("datapoints_added"),
        F.count_if(t == "vector.created").alias("vectors_created"), F.count_if(t == "evaluation.completed").alias("evaluations"), F.coalesce(F.sum(F.when(t == "llm.response", tokens_of())), F.lit(0)).alias("tokens"),
    )


def session_statistics(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """session_id, behavior, status of the metadata, total_events, and counts of the replayed state."""
    totals = events.groupBy("session_id").agg(F.count("*").alias("total_events"), F.countDistinct("event_type").alias("event_kinds"))
    state = replay_state(events).select("session_id", "datapoints", "vectors", "evaluations", "llm_calls", "tokens")
    return metadata.select("session_id", "behavior", F.col("status").alias("metadata_status")).join(totals, "session_id", "left").join(state, "session_id", "left")


def token_usage(events: DataFrame, by: tuple[str, ...] = ("session_id", "model", "source"), estimated: bool = False) -> DataFrame:
    """The columns of `by`, calls and tokens of all responses. model is the one of the paired request; responses without one (or without an id) count
    under a null model."""
    own = _after(events, "llm.request", "llm.response", "request_id", {"model": field("model")}).withColumn("model", F.col("_before.model")).drop("_key", "_before")
    bare = events.where((F.col("event_type") == "llm.response") & (field("request_id").isNull() | F.col("session_id").isNull())).withColumn("model", F.lit(None).cast("string"))
    return own.unionByName(bare).groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens_of(estimated)).alias("tokens"))


#: The fields of a chunk as text, all read from its payload at once.
CHUNK = "request_id string, chunk_index string, chunk string, content string"


def reassemble_chunks(events: DataFrame) -> DataFrame:
    """session_id, request_id, text: chunks joined by chunk_index."""
    own = events.where("event_type = 'llm.chunk'").select("session_id", F.from_json("payload", CHUNK).alias("p"))
    rows = own.select("session_id", "p.request_id", F.struct(F.col("p.chunk_index").cast("int").alias("i"), F.coalesce("p.chunk", "p.content").alias("c")).alias("s"))
    return rows.groupBy("session_id", "request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]), "").alias("text"))


def datapoint_timeline(events: DataFrame) -> DataFrame:
    rows = events.where("event_type in ('datapoint.added', 'datapoint.removed')")
    return rows.select("session_id", "sequence", F.substring_index("event_type", ".", -1).alias("action"), field("datapoint_id").alias("datapoint_id"))


def vectors_created(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'vector.created'")
    return numbered(rows.select("session_id", "sequence", field("vector_id").alias("vector_id"), field("layer", "int").alias("layer")), "session_id", "sequence", "nth")


def best_vector(events: DataFrame) -> DataFrame:
    """session_id, best_layer, vector_id: the vector at the state's best layer, null if none."""
    state = replay_state(events).select("session_id", "best_layer")
    return state.join(replay_vectors(events).select("session_id", F.col("layer").alias("best_layer"), "vector_id"), ["session_id", "best_layer"], "left")


def agent_rollup(events: DataFrame) -> DataFrame:
    """session_id, agent, kind, name, role, status, layer, iterations, pairs, turns, messages, tool_calls, message.

    kind sample: one row per session and sample, as its last optimization left it (tool_calls: its iterations) or, without one, as assigned seeds;
    pairs are core and unique seeds of the last assignment and take the place of tool_calls. kind source: one row per session and source of LLM events (none and
    sample_* apart) with its requests as turns, its messages (requests whose last message says something, responses with content or tool calls) and tool calls.
    """
    sample = F.coalesce(field("sample_idx", "int"), F.lit(0)).alias("sample")
    zero = lambda c: F.coalesce(field(c, "int"), F.lit(0))
    run = F.struct(
        F.coalesce(field("success", "boolean"), F.lit(False)).alias("ok"), zero("layer").alias("layer"), zero("iterations").alias("iterations"), field("final_loss", "double").alias("loss"),
        F.coalesce(field("duration_seconds", "double"), F.lit(0.0)).alias("seconds"), F.coalesce(F.when(field("error") != "", field("error")), F.lit("Unknown error")).alias("error"),
    )
    last = lambda kind, value: events.where(F.col("event_type") == kind).groupBy("session_id", sample).agg(F.max_by(value, "sequence").alias("v")).select("session_id", "sample", "v.*")
    seeds = last("seed.assigned", F.struct(zero("num_core_seeds").alias("core"), zero("num_unique_seeds").alias("unique"))).withColumn("pairs", F.col("core") + F.col("unique"))
    both = last("optimization.completed", run).join(seeds, ["session_id", "sample"], "full")
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    ran = F.col("ok").isNotNull()
    loss = F.coalesce(F.format_string("%.4f", "loss"), F.lit("N/A"))
    done = F.when(F.col("ok"), say("Optimization complete: loss=", loss, ", ", F.col("iterations"), " iterations in ", F.format_string("%.1f", "seconds"), "s")).otherwise(say("Optimization failed: ", F.col("error")))
    samples = both.select(
        "session_id", say("sample_", F.col("sample")).alias("agent"), F.lit("sample").alias("kind"), say("Sample ", F.col("sample") + 1).alias("name"),
        F.when(ran, say("L", F.col("layer"), " iters=", F.col("iterations"))).otherwise(say(F.col("core"), " core + ", F.col("unique"), " unique")).alias("role"),
        F.when(ran & ~F.col("ok"), "error").otherwise("complete").alias("status"), "layer", "iterations", "pairs", F.lit(1).cast("long").alias("turns"), F.lit(1).cast("long").alias("messages"),
        F.coalesce("pairs", "iterations").cast("long").alias("tool_calls"),
        F.when(ran, done).otherwise(say("Assigned ", F.col("core"), " core + ", F.col("unique"), " unique seeds (", F.col("pairs"), " total pairs)")).alias("message"),
    )
    calls = events.where("event_type in ('llm.request', 'llm.response') and source is not null and source not like 'sample\\_%' and source <> ''")
    asks = F.col("event_type") == "llm.request"
    said = F.coalesce(F.try_element_at(F.from_json(field("messages"), "array<struct<content:string>>"), F.lit(-1))["content"], F.lit(""))
    tools = F.coalesce(F.json_array_length(field("tool_calls")), F.lit(0))
    spoken = F.when(asks, said != "").otherwise((F.coalesce(field("content"), F.lit("")) != "") | (tools > 0))
    none = lambda kind: F.lit(None).cast(kind)
    sources = calls.groupBy("session_id", F.col("source").alias("agent")).agg(F.count_if(asks).alias("turns"), F.count_if(spoken).alias("messages"), F.coalesce(F.sum(F.when(~asks, tools)), F.lit(0)).cast("long").alias("tool_calls"))
    sources = sources.select(
        "session_id", "agent", F.lit("source").alias("kind"), F.initcap(F.replace(F.col("agent"), F.lit("_"), F.lit(" "))).alias("name"), F.col("agent").alias("role"), F.lit("complete").alias("status"),
        none("int").alias("layer"), none("int").alias("iterations"), none("int").alias("pairs"), "turns", "messages", "tool_calls", none("string").alias("message"),
    )
    return samples.unionByName(sources)


def session_overview(metadata: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, behavior (the log's name, else the metadata's), shown_status, shown_phase, progress, best_layer, best_strength, overall (best score), datapoints, and of the
    last evaluation behavior_score, coherence_score, specificity_score (absent: 0) and verdict (no evaluation: null)."""
    state = replay_state(events).select("session_id", "behavior_name", "phase", "progress", "best_layer", "best_strength", "best_score", "datapoints")
    score = lambda c: F.coalesce(field(f"scores.{c}", "double"), F.lit(0.0)).alias(f"{c}_score")
    of = F.struct(score("behavior"), score("coherence"), score("specificity"), F.coalesce(field("verdict"), F.lit("needs_refinement")).alias("verdict"))
    last = events.where("event_type = 'evaluation.completed'").groupBy("session_id").agg(F.max_by(of, "sequence").alias("e"))
    out = metadata.join(state, "session_id", "left").join(last, "session_id", "left")
    status = F.when(F.col("status") == "running", "running").when(F.col("status") == "completed", "complete").when(F.col("status") == "failed", "failed").otherwise("pending")
    names = {"initializing": "initializing", "generating": "generating_datapoints", "extracting": "optimizing", "evaluating": "evaluating", "complete": "complete", "failed": "failed"}
    phase = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("phase")), F.lit("initializing"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "session_id", F.coalesce(F.when(F.col("behavior_name") != "", F.col("behavior_name")), "behavior").alias("behavior"), status.alias("shown_status"), phase.alias("shown_phase"), zero("progress").alias("progress"),
        "best_layer", F.coalesce("best_strength", F.lit(1.0)).alias("best_strength"), zero("best_score").alias("overall"), F.coalesce("datapoints", F.lit(0)).alias("datapoints"),
        *(zero(F.col(f"e.{c}_score")).alias(f"{c}_score") for c in ("behavior", "coherence", "specificity")), F.col("e.verdict").alias("verdict"),
    )


def conversation_history(events: DataFrame) -> DataFrame:
    """session_id, request_id, at, role, content: a paired call's request messages in order, then the reply."""
    calls = pair_llm_calls(events).select("session_id", "request_id", "first_sequence", "second_sequence")
    ask = events.select("session_id", F.col("sequence").alias("first_sequence"), F.from_json(field("messages"), "array<struct<role:string,content:string>>").alias("messages"))
    reply = events.select("session_id", F.col("sequence").alias("second_sequence"), F.coalesce(field("content"), F.lit("")).alias("content"))
    both = calls.join(ask, ["session_id", "first_sequence"]).join(reply, ["session_id", "second_sequence"])
    rows = F.concat(F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")), F.array(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))))
    return both.select("session_id", "request_id", "first_sequence", F.posexplode(rows).alias("at", "m")).select("session_id", "request_id", "first_sequence", "at", "m.role", "m.content")


def chat_history(messages: DataFrame) -> DataFrame:
    """conv_id, at, role, text of messages(conv_id, turn, message_type, text): user and steered ones, the latter as assistant."""
    rows = messages.where("message_type in ('user', 'steered')")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return rows.select("conv_id", F.row_number().over(w).alias("at"), F.when(F.col("message_type") == "steered", "assistant").otherwise("user").alias("role"), "text")


def with_fields(events: DataFrame) -> DataFrame:
    """events with _fields, the payload's values by name as text: parsed once for all that reads them."""
    return events.withColumn("_fields", F.from_json("payload", "map<string,string>"))


def log_line() -> tuple[Column, Column, Column]:
    """(source, message, level) of an event of with_fields; all null for chunks. The texts are fixed values."""
    t = F.col("event_type")

    def field(path: str, kind: str = "string") -> Column:
        name, _, rest = path.partition(".")
        value = F.element_at("_fields", name)
        return (F.get_json_object(value, f"$.{rest}") if rest else value).cast(kind)

    text = lambda p, d="": F.coalesce(F.when(field(p) != "", field(p)), F.lit(d))
    number = lambda p: F.coalesce(field(p, "double"), F.lit(0.0))
    whole = lambda p: F.coalesce(field(p, "long"), F.lit(0))
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.round(c, n))
    items = lambda p: F.coalesce(F.json_array_length(field(p)), F.lit(0))
    flag = lambda p, d: F.coalesce(field(p, "boolean"), F.lit(d))
    short = lambda p, n: F.substring(text(p), 1, n)
    optional = lambda p, c: F.when(field(p).isNotNull(), c).otherwise(F.lit(""))
    say = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    own = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("llm"))
    info, warning, error = F.lit("info"), F.lit("warning"), F.lit("error")
    # kind -> (source, message, level)
    lines: dict[str, tuple[Column, Column, Column]] = {
        "session.started": (F.lit("session"), say("Started extraction: ", text("behavior_name", "unknown")), info),
        "session.completed": (
            F.lit("session"),
            F.when(flag("success", False), say("Completed successfully", optional("final_score", say(" | score: ", fixed(number("final_score"), 3))), optional("final_layer", say(" | layer: ", whole("final_layer"))))).otherwise(say("Failed: ", text("error", "unknown error"))),
            F.when(flag("success", False), info).otherwise(error),
        ),
        "contrast.pipeline_started": (F.lit("contrast"), say("Starting contrast generation (", whole("num_samples"), " samples)"), info),
        "contrast.behavior_analyzed": (F.lit("contrast"), say("Behavior analyzed: ", whole("num_components"), " components, ", items("contrast_dimensions"), " contrast dimensions"), info),
        "contrast.pipeline_completed": (F.lit("contrast"), say("Contrast complete: ", whole("total_valid_pairs"), "/", whole("total_pairs_generated"), " valid pairs | quality: ", fixed(number("avg_quality"), 2), " | ", fixed(number("duration_seconds"), 1), "s"), info),
        "contrast.pair_generated": (F.lit("contrast"), say("Sample ", whole("sample_idx"), ": generated pair ", short("pair_id", 8)), info),
        "contrast.pair_validated": (
            F.lit("contrast"),
            F.when(flag("is_valid", False), say("Pair ", short("pair_id", 8), " valid: quality=", fixed(number("contrast_quality"), 2), " (dst=", fixed(number("dst_score"), 2), ", src=", fixed(number("src_score"), 2), ")")).otherwise(say("Pair ", short("pair_id", 8), " rejected: ", text("rejection_reason", "unknown"))),
            F.when(flag("is_valid", False), info).otherwise(warning),
        ),
        "seed.generation_started": (F.lit("seed"), say("Generating ", whole("num_seeds_requested"), " seeds for '", text("behavior_name"), "'"), info),
        "seed.generated": (F.lit("seed"), say("Seed ", short("seed_id", 8), F.when(flag("is_core", False), " (core)").otherwise(" (unique)"), ": quality=", fixed(number("quality_score"), 2), " | ", short("scenario", 50), "..."), info),
        "seed.generation_completed": (F.lit("seed"), say("Seed generation complete: ", whole("total_generated"), " generated, ", whole("total_filtered"), " filtered | avg quality: ", fixed(number("avg_quality"), 2)), info),
        "seed.assigned": (F.lit("seed"), say("Sample ", whole("sample_idx"), ": assigned ", whole("num_core_seeds"), " core + ", whole("num_unique_seeds"), " unique seeds"), info),
        "datapoint.added": (F.lit("datapoint"), say("Added ", short("datapoint_id", 12), " (domain: ", text("domain", "unknown"), ")"), info),
        "datapoint.removed": (F.lit("datapoint"), say("Removed ", short("datapoint_id", 12), ": ", text("reason", "no reason")), warning),
        "datapoint.quality": (F.lit("datapoint"), say("Quality ", short("datapoint_id", 12), ": ", fixed(number("quality_score"), 2), " → ", text("recommendation", "KEEP")), info),
        "optimization.started": (F.lit("optimizer"), say("Sample ", whole("sample_idx"), ": starting layer ", whole("layer"), " optimization (", whole("num_datapoints"), " datapoints)"), info),
        "optimization.progress": (F.lit("optimizer"), say("Sample ", whole("sample_idx"), ": iter ", whole("iteration"), " | loss: ", fixed(number("loss"), 6)), info),
        "optimization.completed": (
            F.lit("optimizer"),
            F.when(~flag("success", True), say("Sample ", whole("sample_idx"), " layer ", whole("layer"), " FAILED: ", text("error", "unknown")))
            .when((items("loss_history") == 0) & (whole("iterations") == 1), say("Sample ", whole("sample_idx"), " layer ", whole("layer"), ": extracted | ", fixed(number("duration_seconds"), 1), "s"))
            .otherwise(say("Sample ", whole("sample_idx"), " layer ", whole("layer"), ": loss=", fixed(number("final_loss"), 6), " | ", whole("iterations"), " iters | ", fixed(number("duration_seconds"), 1), "s")),
            F.when(flag("success", True), info).otherwise(error),
        ),
        "optimization.aggregation_completed": (F.lit("optimizer"), say("Aggregated (", text("strategy", "unknown"), "): ", whole("num_vectors"), " vectors, top-", whole("top_k"), " | score: ", fixed(number("final_score"), 3), " | layer: ", whole("final_layer")), info),
        "vector.created": (F.lit("vector"), say("Created ", short("vector_id", 8), " at layer ", whole("layer"), " | norm: ", fixed(number("norm"), 4)), info),
        "vector.comparison": (F.lit("vector"), say("Compared ", items("vector_ids"), " vectors"), info),
        "vector.selected": (
            F.lit("vector"),
            say("Selected layer ", whole("layer"), " @ strength ", fixed(F.coalesce(field("strength", "double"), F.lit(1.0)), 2), optional("score", say(" | score: ", fixed(number("score"), 3))), F.when(text("reason") != "", say(" | ", text("reason"))).otherwise(F.lit(""))),
            info,
        ),
        "evaluation.started": (F.lit("evaluation"), say("Started ", text("eval_type", "quick"), " eval ", short("evaluation_id", 8), ": layer ", whole("layer"), ", ", items("strength_levels"), " strengths"), info),
        "evaluation.output": (F.lit("evaluation"), say("Eval ", short("evaluation_id", 8), " output (", F.when(flag("is_baseline", False), F.lit("baseline")).otherwise(say("strength=", fixed(F.coalesce(field("strength", "double"), F.lit(1.0)), 2))), ")"), info),
        "evaluation.completed": (F.lit("evaluation"), say("Eval ", short("evaluation_id", 8), " complete: ", fixed(number("scores.overall"), 3), " | ", text("verdict", "unknown"), " | rec. strength: ", fixed(F.coalesce(field("recommended_strength", "double"), F.lit(1.0)), 2)), info),
        "checkpoint.created": (F.lit("checkpoint"), say("Created checkpoint ", short("checkpoint_id", 8), ": ", text("description")), info),
        "checkpoint.rollback": (F.lit("checkpoint"), say("Rolled back to ", short("checkpoint_id", 8), " (seq ", whole("previous_sequence"), ")"), warning),
        "state.update": (F.lit("state"), say("Updated ", text("field", "unknown"), ": ", text("old_value", "None"), " → ", text("new_value", "None")), info),
        "state.iteration_started": (F.lit("state"), say(text("iteration_type", "unknown"), " iteration ", whole("iteration"), F.when(whole("max_iterations") > 0, say("/", whole("max_iterations"))).otherwise(F.lit("")), " started"), info),
        "state.iteration_completed": (F.lit("state"), say(text("iteration_type", "unknown"), " iteration ", whole("iteration"), " completed"), info),
        "llm.request": (own, say("Request: ", text("model", "unknown"), " (", items("messages"), " messages", F.when(items("tools") > 0, say(" | ", items("tools"), " tools")).otherwise(F.lit("")), ")"), info),
        "llm.response": (
            own,
            F.when(text("error") != "", say("Response ERROR: ", text("error"))).when(items("tool_calls") > 0, say("Response: ", items("tool_calls"), " tool calls | ", text("latency_ms", "0"), "ms")).otherwise(say("Response: ", text("finish_reason", "stop"), " | ", text("latency_ms", "0"), "ms")),
            F.when(text("error") != "", error).otherwise(info),
        ),
        "tool.call": (F.lit("tool"), say("Calling ", text("tool_name", "unknown"), " (", short("call_id", 8), ")"), info),
        "tool.result": (F.lit("tool"), F.when(flag("success", True), say("Result ", short("call_id", 8), ": success | ", text("latency_ms", "0"), "ms")).otherwise(say("Result ", short("call_id", 8), ": FAILED - ", text("error", "unknown"))), F.when(flag("success", True), info).otherwise(error)),
    }
    none = F.lit(None).cast("string")
    out = [F.when(t == "llm.chunk", none), F.when(t == "llm.chunk", none), F.when(t == "llm.chunk", none)]
    for kind, parts in lines.items():
        out = [c.when(t == kind, p) for c, p in zip(out, parts, strict=True)]
    other = (F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("unknown")), say("Event: ", t), info)
    return tuple(c.otherwise(p) for c, p in zip(out, other, strict=True))


def event_logs(events: DataFrame, keep: int | None = 10_000) -> DataFrame:
    """session_id, sequence, log_source, message, level without chunks; the last `keep` of each session."""
    source, message, level = log_line()
    # only chunks have no line; a test of the message would evaluate it twice
    out = with_fields(events.where("event_type <> 'llm.chunk'")).select("session_id", "sequence", source.alias("log_source"), message.alias("message"), level.alias("level"))
    if keep is None:
        return out
    return last_rows(out, "session_id", "sequence", keep)


def filter_logs(logs: DataFrame, session: str | None = None, text: str | None = None, source: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """Rows of the session or of none; text in message or source, case apart; exact source; level in a list."""
    if session is not None:
        logs = logs.where(F.col("session_id").isNull() | (F.col("session_id") == session))
    if text:
        logs = logs.where(F.lower("message").contains(text.lower()) | F.lower("log_source").contains(text.lower()))
    if source is not None:
        logs = logs.where(F.col("log_source") == source)
    return logs.where(F.col("level").isin(levels)) if levels else logs


def log_level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("session_id").pivot("level", ["info", "warning", "error"]).count().na.fill(0)


def log_sources(logs: DataFrame) -> DataFrame:
    return logs.select("log_source").distinct().orderBy("log_source")


def run_status_counts(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "completed").alias("complete"), F.count("*").alias("total"))


def progress(events: DataFrame, planned: DataFrame, kind: str = "optimization.completed") -> DataFrame:
    """session_id, done, total, share, rate a second, remaining seconds of planned(session_id, total); no total or rate: 0."""
    done = events.groupBy("session_id").agg(F.count_if(F.col("event_type") == kind).alias("done"), ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("elapsed"))
    rate = F.when(F.col("elapsed") > 0, F.col("done") / F.col("elapsed")).otherwise(0.0)
    out = planned.join(done, "session_id", "left").na.fill({"done": 0, "elapsed": 0.0}).withColumn("rate", rate)
    return out.withColumns({"share": F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0), "remaining": F.when(F.col("rate") > 0, (F.col("total") - F.col("done")) / F.col("rate")).otherwise(0.0)})
