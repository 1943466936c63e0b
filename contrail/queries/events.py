"""Queries on event logs: files, pairing, replay, statistics, log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.fixtures import aux_log, event_log, read, session_metadata, sql
from contrail.operators import replay as r
from contrail.operators import snapshots as snap
from contrail.queries.vectors import rounded
from contrail.sources import events as src
from contrail.sources.scratch import FOLDERS, PIECE, folder_of, kept, shared_folder


def _lines(rows):
    """Rows as JSON lines, with blank, truncated and unknown-category lines between."""
    # payloads keep their types: the object's text takes the place of a string
    body = F.to_json(F.struct(*(c for c in src.ENVELOPE.fieldNames() if c != "payload")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    line = F.concat(F.substring(body, 1, F.length(body) - 1), F.lit(', "payload": '), "payload", F.lit("}"))
    bad = F.when(F.col("sequence") % 50 == 0, F.array(line, F.lit(""), F.substring(line, 1, 40), F.regexp_replace(line, '"category":"[a-z]+"', '"category":"nonsense"'))).otherwise(F.array(line))
    return rows.select("session_id", "sequence", F.explode(bad).alias("value"))


def written_log(spark, d, name: str = "log"):
    """The event log as JSON lines in the shared folder; its path."""
    path = shared_folder(spark, name)
    _lines(event_log(spark, d)).select("value").write.text(path)
    return path


def session_logs(spark, d, name: str, clock: bool = False):
    """The event log as JSON lines in FOLDERS folders, all of a session's in one; its path. clock: a session more, with one event long after all others, moves the watermark."""
    path = shared_folder(spark, name)
    rows = event_log(spark, d)
    if clock:
        tick = rows.agg(F.max("timestamp").alias("t")).selectExpr(
            "'clock' as event_id", "'clock' as session_id", "t + interval 1 day as timestamp", "1L as sequence", "'llm' as category", "'llm.request' as event_type", "'clock' as source", """'{"request_id": "tick"}' as payload"""
        )
        rows = rows.unionByName(tick)
    lines = _lines(rows).withColumn("folder", folder_of("session_id")).repartition("folder", F.floor(F.col("sequence") / PIECE))
    lines.select("folder", "value").write.partitionBy("folder").text(path)
    return path


def _read(s, d):
    out = src.read_events(s, written_log(s, d), categories=["llm", "datapoint"], after_sequence=5)
    return out.groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.sum("sequence").alias("sequences"))


def _quarantine(s, d):
    return src.read_quarantine(s, written_log(s, d)).agg(F.count("*").alias("n"))


KINDS = {"vector.created": "cast(layer as double)", "optimization.completed": "final_loss", "evaluation.completed": "scores['overall']", "llm.response": "cast(usage.total_tokens as double)", "session.started": "cast(length(behavior_name) as double)"}


def _kinds(s, d):
    out = None
    for kind, value in KINDS.items():
        rows = src.events_of(event_log(s, d), kind).selectExpr("session_id", "sequence", f"'{kind}' as kind", f"{value} as value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _seeds(s, d):
    log = event_log(s, d).where("event_type = 'checkpoint.created'").withColumn("k", F.regexp_extract("payload", "cp([0-9]+)", 1).cast("int"))
    body = F.expr("to_json(named_struct('seed_id', concat('s', k % 4), 'scenario', concat('sc', k), 'context', 'x', 'quality_score', k / cast(10 as double), 'is_core', k % 3 = 0))")
    return r.replay_seeds(log.withColumn("payload", body).withColumn("event_type", F.lit("seed.generated")))


def _append(s, d):
    old = event_log(s, d)
    new = event_log(s, d).withColumnRenamed("sequence", "pos")  # the whole log once more
    path = shared_folder(s, "append")
    src.append_events(new, old, path, FOLDERS)
    return s.read.schema("session_id string, sequence long, category string, event_type string").json(path).select("session_id", "sequence", "category", "event_type")


def _sessions(s, d):
    path = shared_folder(s, "sessions")
    # a file holds an array of sessions
    rows = session_metadata(s, d).groupBy(folder_of("session_id", FOLDERS).alias("dir")).agg(F.to_json(F.collect_list(F.struct(*session_metadata(s, d).columns))).alias("value"))
    rows.write.partitionBy("dir").text(path)
    found = src.read_session_metadata(s, path, "*/*.txt")
    return src.list_sessions(found, status="completed", limit=20).select("session_id", "behavior", "created_at", "final_score")


def _merge(s, d):
    cur = session_metadata(s, d).selectExpr("session_id", "explode(map('behavior', behavior, 'status', 'running')) as (key, value)")
    new = session_metadata(s, d).where("status <> 'running'").selectExpr("session_id", "explode(map('status', status, 'error', 'none')) as (key, value)")
    return src.merge_session_metadata(cur, new, F.lit("2024-06-01T00:00:00Z"))


def _chunks(s, d):
    docs = read(s, d, "documents").selectExpr("cast(doc_id % 10 as string) as session_id", "concat('r', doc_id) as request_id", "text")
    cut = docs.select("session_id", "request_id", F.posexplode(F.expr("if(length(text) > 0, regexp_extract_all(text, '(?s).{1,20}', 0), array(text))")).alias("i", "c"))
    events = cut.select("session_id", F.lit("llm.chunk").alias("event_type"), F.to_json(F.struct("request_id", F.col("i").alias("chunk_index"), F.col("c").alias("content"))).alias("payload"))
    return r.reassemble_chunks(events).select("request_id", F.md5("text").alias("text_md5"))


def _conversation(s, d):
    return r.conversation_history(event_log(s, d)).select("session_id", "request_id", "first_sequence", "at", "role", "content")


def _chat(s, d):
    rows = read(s, d, "conversations").selectExpr("conv_id", "turn", "text", "case role when 'assistant' then if(turn % 4 = 1, 'steered', 'baseline') else role end as message_type")
    return r.chat_history(rows).select("conv_id", "at", "role", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def _children(s, d):
    return r.replay_vectors(event_log(s, d))


def _rollback(honor):
    def run(s, d):
        log = event_log(s, d)
        marks = F.when(F.col("sequence") % 20 == 0, F.lit("checkpoint.rollback")).otherwise(F.col("event_type"))
        body = F.when(F.col("sequence") % 20 == 0, F.to_json(F.struct((F.col("sequence") - 5).alias("previous_sequence")))).otherwise(F.col("payload"))
        return r.apply_rollback(log.withColumn("event_type", marks).withColumn("payload", body), honor).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("sequence").alias("sequences"))

    return run


def _resumed(honor):
    """A snapshot of the first two thirds of each session, written and read, and the rest of the log, some of which it holds already."""

    def run(s, d):
        log = event_log(s, d)
        if honor is not None:
            marks = F.col("sequence") % 20 == 0
            log = log.withColumn("payload", F.when(marks, F.to_json(F.struct((F.col("sequence") - 5).alias("previous_sequence")))).otherwise(F.col("payload"))).withColumn("event_type", F.when(marks, F.lit("checkpoint.rollback")).otherwise(F.col("event_type")))
        share = log.groupBy("session_id").agg((F.max("sequence") * 2 / 3).alias("cut"))
        log = kept(log.join(share, "session_id"))  # a log is a table: what reads it several times doesn't derive it anew
        path = shared_folder(s, "snapshot")
        snap.write_snapshot(snap.take_snapshot(log.where("sequence <= cut").drop("cut"), bool(honor)), path)
        out = snap.resume(snap.read_snapshot(s, path), log.where("sequence > cut - 10").drop("cut"), bool(honor), log.drop("cut"))
        return snap.state(out)

    return run


def _progress(s, d):
    planned = session_metadata(s, d).select("session_id", (F.col("event_count") / 5).cast("long").alias("total"))
    return rounded(r.progress(event_log(s, d), planned), "elapsed", "rate", "share", "remaining", places=4)


QUERIES = {
    "a1_read_events": _read,
    "a1_quarantine": _quarantine,
    "a2_event_category": lambda s, d: event_log(s, d).select(src.event_category(F.when(F.col("sequence") % 7 == 0, F.concat(F.lit("x."), "event_type")).otherwise(F.col("event_type"))).alias("category")).groupBy("category").agg(F.count("*").alias("n")),
    "a3_events_of": lambda s, d: src.events_of(event_log(s, d), "vector.selected").select("session_id", "sequence", "layer", "strength", "score"),
    "a3_events_of_kinds": _kinds,
    "a4_append_events": _append,
    "a5_list_sessions": _sessions,
    "a6_latest_session": lambda s, d: src.latest_session(session_metadata(s, d), "b2").select("session_id", "created_at"),
    "a7_merge_session_metadata": _merge,
    "a8_session_info": lambda s, d: src.session_info(session_metadata(s, d), F.lit("2024-01-01 00:00:00").cast("timestamp")).select("session_id", "behavior", "status", "duration", "clock", "event_count"),
    "a13_recent_events": lambda s, d: src.recent_events(event_log(s, d), 10).select("session_id", "sequence", "event_type"),
    "c1_pair_llm_calls": lambda s, d: rounded(r.pair_llm_calls(event_log(s, d)), "seconds", places=3),
    "c2_pair_tool_calls": lambda s, d: rounded(r.pair_tool_calls(aux_log(s, d)), "seconds", places=3),
    "c3_replay_pairs": lambda s, d: r.replay_pairs(aux_log(s, d)),
    "c4_replay_datapoints": lambda s, d: r.replay_datapoints(aux_log(s, d)),
    "d24_event_counts": lambda s, d: r.event_counts(event_log(s, d)),
    "d25_session_summary": lambda s, d: r.session_summary(event_log(s, d)),
    "d26_session_statistics": lambda s, d: r.session_statistics(event_log(s, d), session_metadata(s, d)),
    "d27_token_usage": lambda s, d: r.token_usage(event_log(s, d)),
    "d28_log_level_counts": lambda s, d: r.log_level_counts(r.event_logs(event_log(s, d), None)),
    "d28_log_sources": lambda s, d: r.log_sources(r.event_logs(event_log(s, d), None)),
    "d30_reassemble_chunks": _chunks,
    "d32_run_status_counts": lambda s, d: r.run_status_counts(session_metadata(s, d)),
    "d33_progress": _progress,
    "e14_datapoint_timeline": lambda s, d: r.datapoint_timeline(event_log(s, d)),
    "e15_vectors_created": lambda s, d: r.vectors_created(event_log(s, d)),
    "e16_best_vector": lambda s, d: r.best_vector(event_log(s, d)),
    "g10_log_line": lambda s, d: r.event_logs(event_log(s, d), None),
    "b16_filter_logs": lambda s, d: r.filter_logs(r.event_logs(event_log(s, d), None), text="response", levels=["info"]).select("session_id", "sequence"),
    "g14_chat_history": _chat,
    "g15_conversation_history": _conversation,
    "h1_replay_state": lambda s, d: r.replay_state(event_log(s, d)),
    "h1_replay_from_snapshot": _resumed(None),
    "h3_replay_from_snapshot_honored": _resumed(True),
    "h2_replay_vectors": _children,
    "h2_replay_seeds": _seeds,
    "h2_replay_optimizations": lambda s, d: r.replay_optimizations(event_log(s, d)).select("session_id", "sequence", "sample_idx", "layer", "final_loss", "success"),
    "h2_replay_evaluations": lambda s, d: r.replay_evaluations(event_log(s, d)),
    "h2_replay_seed_assignments": lambda s, d: r.replay_seed_assignments(aux_log(s, d)),
    "h3_apply_rollback": _rollback(False),
    "h3_apply_rollback_honored": _rollback(True),
    "h4_agent_rollup": lambda s, d: r.agent_rollup(event_log(s, d).unionByName(aux_log(s, d).where("event_type = 'seed.assigned'"))),
    "h5_session_overview": lambda s, d: r.session_overview(session_metadata(s, d), event_log(s, d)),
    "h6_event_logs": lambda s, d: r.event_logs(event_log(s, d), 20).select("session_id", "sequence", "message"),
}

_PAIRED = """c as (select *, lag(event_type) over w as pt, lag(sequence) over w as ps, lag(timestamp) over w as pts, lag(k) over w as pk from {log} where event_type in ('{a}', '{b}') window w as (partition by session_id, {key} order by sequence)),
p as (select * from c where event_type = '{b}' and pt = '{a}')"""
_CALLS = _PAIRED.format(log="event_log", a="llm.request", b="llm.response", key="request_id")
_TOKENS = "case when k % 9 = 0 then 0 else k end"
_LIVE = """last_pt as (select session_id, point_id, max(sequence) as sequence, max_by(event_type, sequence) as t from {log} where event_type in ('datapoint.added', 'datapoint.removed') group by all),
live as (select session_id, point_id, sequence from last_pt where t = 'datapoint.added')"""
_POINTS = "(select *, 'd' || (k % 20) as point_id from event_log)"
_DEC = "round((value / 100)::decimal(18, 4), 3)"
_LINES = f"""lines as (select session_id, sequence, case split_part(event_type, '.', 1) when 'llm' then source when 'optimization' then 'optimizer' else split_part(event_type, '.', 1) end as log_source, case event_type
  when 'session.started' then 'Started extraction: b' || k when 'checkpoint.created' then 'Created checkpoint cp' || k || ': '
  when 'llm.request' then 'Request: m' || (k % 3) || ' (' || (k % 3) || ' messages)' when 'llm.response' then case when k % 5 = 0 then 'Response: 1 tool calls | 0ms' else 'Response: stop | 0ms' end
  when 'datapoint.added' then 'Added d' || (k % 20) || ' (domain: unknown)' when 'datapoint.removed' then 'Removed d' || (k % 20) || ': no reason'
  when 'vector.created' then 'Created v' || (k % 20) || ' at layer ' || (k % 8) || ' | norm: 0.0000'
  when 'vector.selected' then 'Selected layer ' || (k % 8) || ' @ strength 1.00 | score: ' || {_DEC}
  when 'optimization.completed' then case when k % 2 = 0 then 'Sample ' || (k % 4) || ' layer ' || (k % 8) || ': loss=' || round(value, 2)::decimal(18, 6) || ' | 0 iters | 0.0s' else 'Sample ' || (k % 4) || ' layer ' || (k % 8) || ' FAILED: unknown' end
  when 'evaluation.completed' then 'Eval ' || ('e' || k)[:8] || ' complete: ' || {_DEC} || case when k % 4 = 1 then ' | accepted' else ' | unknown' end || ' | rec. strength: 1.00'
  else 'Updated unknown: None → None' end as message,
  case when event_type = 'datapoint.removed' then 'warning' when event_type = 'optimization.completed' and k % 2 = 1 then 'error' else 'info' end as level from event_log)"""
_STATE = f"""sel as (select session_id, max(sequence) as set_at, max_by(round(value / 100, 4), sequence) as base from event_log where event_type = 'vector.selected' group by 1),
ev as (select e.session_id, max(round(value / 100, 4)) as top from event_log e left join sel using (session_id) where event_type = 'evaluation.completed' and sequence > coalesce(set_at, -1) group by 1),
runs as (select session_id, min(round(value, 2)) as best_loss, arg_min(k % 8, (round(value, 2), sequence)) as best_loss_layer from event_log where event_type = 'optimization.completed' and k % 2 = 0 group by 1),
{_LIVE.format(log=_POINTS)}, pts as (select session_id, count(*) as n from live group by 1),
state as (select e.session_id, coalesce(max_by('b' || k, sequence) filter (where event_type = 'session.started'), '') as behavior_name,
  case when count(*) filter (where event_type = 'session.started') > 0 then 'running' else '' end as status, case when count(*) filter (where event_type = 'session.started') > 0 then 'initializing' else '' end as phase,
  max_by(k % 8, sequence) filter (where event_type = 'vector.selected') as best_layer, 1.0 as best_strength, 0 as iteration, count(*) filter (where event_type = 'llm.response') as llm_calls, 0 as tool_calls,
  coalesce(sum({_TOKENS}) filter (where event_type = 'llm.response'), 0) as tokens, count(distinct k % 8) filter (where event_type = 'vector.created') as vectors, count(*) filter (where event_type = 'evaluation.completed') as evaluations,
  case when count(*) filter (where event_type = 'evaluation.completed') > 0 then 0.9 else 0 end as progress from event_log e group by 1),
full_state as (select state.*, greatest(coalesce(base, 0), coalesce(top, coalesce(base, 0))) as best_score, best_loss, best_loss_layer, coalesce(n, 0) as datapoints from state left join sel using (session_id) left join ev using (session_id) left join runs using (session_id) left join pts using (session_id))"""
_SECONDS = "round(epoch_us({a}) / 1e6 - epoch_us({b}) / 1e6, 3)"

ORACLE = {
    "a1_read_events": sql("select session_id, event_type, count(*) as n, sum(sequence) as sequences from event_log where (event_type like 'llm.%' or event_type like 'datapoint.%') and sequence > 5 group by all", "event_log"),
    "a1_quarantine": sql("select 2 * count(*) as n from event_log where sequence % 50 = 0", "event_log"),
    "a2_event_category": sql("select case when sequence % 7 = 0 then 'state' else split_part(event_type, '.', 1) end as category, count(*) as n from event_log group by 1", "event_log"),
    "a3_events_of": sql("select session_id, sequence, k % 8 as layer, 1.0 as strength, round(value / 100, 4) as score from event_log where event_type = 'vector.selected'", "event_log"),
    "a3_events_of_kinds": sql(
        """select session_id, sequence, event_type as kind, case event_type when 'vector.created' then k % 8 when 'optimization.completed' then round(value, 2) when 'evaluation.completed' then round(value / 100, 4)
        when 'session.started' then length('b' || k) when 'llm.response' then case when k % 9 <> 0 then k end end::double as value
        from event_log where event_type in ('vector.created', 'optimization.completed', 'evaluation.completed', 'llm.response', 'session.started')""",
        "event_log",
    ),
    "a4_append_events": sql("select session_id, sequence + count(*) over (partition by session_id) as sequence, split_part(event_type, '.', 1) as category, event_type from event_log", "event_log"),
    "h2_replay_seeds": sql("select session_id, 's' || (k % 4) as seed_id, max_by('sc' || k, sequence) as scenario, 'x' as context, max_by(k / 10.0::double, sequence) as quality_score, max_by(k % 3 = 0, sequence) as is_core from event_log where event_type = 'checkpoint.created' group by 1, 2", "event_log"),
    "h2_replay_optimizations": sql("select session_id, sequence, k % 4 as sample_idx, k % 8 as layer, round(value, 2) as final_loss, k % 2 = 0 as success from event_log where event_type = 'optimization.completed'", "event_log"),
    "h2_replay_evaluations": sql("select session_id, sequence, 'e' || k as evaluation_id, 'quick' as eval_type, round(value / 100, 4) as overall, case when k % 4 = 1 then 'accepted' else 'needs_refinement' end as verdict, 1.0::double as recommended_strength from event_log where event_type = 'evaluation.completed'", "event_log"),
    "a5_list_sessions": sql("select session_id, behavior, created_at, final_score from session_metadata where status = 'completed' and not hidden order by session_metadata.created_at desc nulls last, session_id limit 20", "session_metadata"),
    "a6_latest_session": sql("select session_id, created_at from session_metadata where behavior = 'b2' and not hidden order by session_metadata.created_at desc nulls last, session_id limit 1", "session_metadata"),
    "a7_merge_session_metadata": sql(
        """done as (select * from session_metadata where status <> 'running') select session_id, 'behavior' as key, behavior as value from session_metadata union all select session_id, 'status', status from session_metadata
        union all select session_id, 'error', 'none' from done union all select session_id, 'updated_at', '2024-06-01T00:00:00Z' from done union all select session_id, 'completed_at', '2024-06-01T00:00:00Z' from done""",
        "session_metadata",
    ),
    "a8_session_info": sql(
        """x as (select *, case when completed_at is null then 0 else epoch_us(b) / 1e6 - epoch_us(case when created_at is null then timestamp '2024-01-01' else a end) / 1e6 end as duration from session_metadata)
        select session_id, behavior, status, duration, printf('%02d:%02d', floor(duration / 60)::int, floor(duration)::int % 60) as clock, event_count from x""",
        "session_metadata",
    ),
    "a13_recent_events": sql("select session_id, sequence, event_type from event_log qualify row_number() over (partition by session_id order by sequence desc) <= 10", "event_log"),
    "c1_pair_llm_calls": sql(f"{_CALLS} select session_id, request_id, ps as first_sequence, sequence as second_sequence, {_SECONDS.format(a='timestamp', b='pts')} as seconds, 'm' || (pk % 3) as model, {_TOKENS} as tokens from p", "event_log"),
    "c2_pair_tool_calls": sql(
        _PAIRED.format(log="aux_log", a="tool.call", b="tool.result", key="call_id") + f" select session_id, call_id, ps as first_sequence, sequence as second_sequence, {_SECONDS.format(a='timestamp', b='pts')} as seconds, 't' || (pk % 5) as tool_name, value < 50 as success from p", "aux_log"
    ),
    "c3_replay_pairs": sql(
        """g as (select session_id, pair_id, max(sequence) as sequence from aux_log where event_type = 'contrast.pair_generated' group by all),
        v as (select g.session_id, g.pair_id, max_by(k % 2 = 0, a.sequence) as ok, max_by(round(value / 10, 4), a.sequence) as q from g join aux_log a on a.session_id = g.session_id and a.pair_id = g.pair_id and a.event_type = 'contrast.pair_validated' and a.sequence > g.sequence group by all)
        select session_id, pair_id, sequence, coalesce(ok, false) as is_valid, coalesce(q, 0) as contrast_quality from g left join v using (session_id, pair_id)""",
        "aux_log",
    ),
    "c4_replay_datapoints": sql(
        _LIVE.format(log="aux_log")
        + """, q as (select l.session_id, l.point_id, max_by(case when k % 2 = 0 then 'KEEP' else 'REVIEW' end, a.sequence) as rec from live l join aux_log a on a.session_id = l.session_id and a.quality_id = l.point_id and a.event_type = 'datapoint.quality' and a.sequence > l.sequence group by all)
        select session_id, point_id as datapoint_id, sequence, rec as recommendation from live left join q using (session_id, point_id)""",
        "aux_log",
    ),
    "d24_event_counts": sql("select session_id, event_type, count(*) as n from event_log group by rollup (session_id, event_type)", "event_log"),
    "d25_session_summary": sql(
        f"""select session_id, count(*) filter (where event_type = 'llm.response') as llm_calls, 0 as tool_calls, count(*) filter (where event_type = 'datapoint.added') as datapoints_added, count(*) filter (where event_type = 'vector.created') as vectors_created,
        count(*) filter (where event_type = 'evaluation.completed') as evaluations, coalesce(sum({_TOKENS}) filter (where event_type = 'llm.response'), 0) as tokens from event_log group by 1""",
        "event_log",
    ),
    "d26_session_statistics": sql(
        f"{_STATE}, t as (select session_id, count(*) as total_events, count(distinct event_type) as event_kinds from event_log group by 1) select m.session_id, m.behavior, m.status as metadata_status, total_events, event_kinds, datapoints, vectors, evaluations, llm_calls, tokens from session_metadata m left join t using (session_id) left join full_state f using (session_id)",
        "event_log", "session_metadata",
    ),
    "d27_token_usage": sql(f"{_CALLS} select session_id, case when pt = 'llm.request' then 'm' || (pk % 3) end as model, source, count(*) as calls, sum({_TOKENS}) as tokens from c where event_type = 'llm.response' group by all", "event_log"),
    "d28_log_level_counts": sql(f"{_LINES} select session_id, count(*) filter (where level = 'info') as info, count(*) filter (where level = 'warning') as warning, count(*) filter (where level = 'error') as error from lines group by 1", "event_log"),
    "d28_log_sources": sql(f"{_LINES} select distinct log_source from lines", "event_log"),
    "d30_reassemble_chunks": "select 'r' || doc_id as request_id, md5(text) as text_md5 from documents",
    "d32_run_status_counts": sql("select count(*) filter (where status = 'running') as running, count(*) filter (where status = 'completed') as complete, count(*) as total from session_metadata", "session_metadata"),
    "d33_progress": sql(
        """x as (select session_id, count(*) filter (where event_type = 'optimization.completed') as done, epoch_us(max(timestamp)) / 1e6 - epoch_us(min(timestamp)) / 1e6 as elapsed from event_log group by 1),
        y as (select session_id, event_count // 5 as total, done, elapsed, case when elapsed > 0 then done / elapsed else 0 end as rate from session_metadata join x using (session_id))
        select session_id, total, done, round(elapsed, 4) as elapsed, round(rate, 4) as rate, round(case when total > 0 then done / total else 0 end, 4) as share, round(case when rate > 0 then (total - done) / rate else 0 end, 4) as remaining from y""",
        "event_log", "session_metadata",
    ),
    "e14_datapoint_timeline": sql("select session_id, sequence, split_part(event_type, '.', 2) as action, 'd' || (k % 20) as datapoint_id from event_log where event_type like 'datapoint.%'", "event_log"),
    "e15_vectors_created": sql("select session_id, sequence, row_number() over (partition by session_id order by sequence) as nth, 'v' || (k % 20) as vector_id, k % 8 as layer from event_log where event_type = 'vector.created'", "event_log"),
    "e16_best_vector": sql(f"{_STATE}, v as (select session_id, k % 8 as layer, max_by('v' || (k % 20), sequence) as vector_id from event_log where event_type = 'vector.created' group by all) select f.session_id, best_layer, vector_id from full_state f left join v on v.session_id = f.session_id and v.layer = best_layer", "event_log"),
    "g10_log_line": sql(f"{_LINES} select * from lines", "event_log"),
    "b16_filter_logs": sql(f"{_LINES} select session_id, sequence from lines where contains(lower(message), 'response') and level = 'info'", "event_log"),
    "g14_chat_history": """with m as (select *, case when role = 'assistant' then case when turn % 4 = 1 then 'steered' else 'baseline' end else role end as t from conversations)
        select conv_id, row_number() over (partition by conv_id order by turn) as at, case when t = 'steered' then 'assistant' else 'user' end as role, md5(coalesce(text, '')) as text_md5 from m where t in ('user', 'steered')""",
    "g15_conversation_history": sql(
        f"""{_CALLS}, r as (select *, unnest(range(0, pk % 3 + 1)) as i from p) select session_id, request_id, ps as first_sequence, i as "at", case when i = pk % 3 then 'assistant' when i = 0 then 'system' else 'user' end as role,
        case when i = pk % 3 then case when k % 4 = 0 then '' else 'r' || k end when i = 0 then 's' || pk when pk % 7 = 0 then '' else 'q' || pk end as content from r""",
        "event_log",
    ),
    "h1_replay_state": sql(f"{_STATE} select * from full_state", "event_log"),
    "h1_replay_from_snapshot": sql(f"{_STATE} select * from full_state", "event_log"),
    "h3_replay_from_snapshot_honored": sql(f"{_STATE.replace('event_log', 'kept')} select * from full_state", "event_log").replace("sel as (", """kept as (
  select e.* from event_log e where e.sequence % 20 <> 0 and not exists (select 1 from event_log m where m.session_id = e.session_id and m.sequence % 20 = 0 and e.sequence > m.sequence - 5 and e.sequence < m.sequence)),
sel as (""", 1),
    "h2_replay_vectors": sql("select session_id, k % 8 as layer, max_by('v' || (k % 20), sequence) as vector_id, max(sequence) as sequence from event_log where event_type = 'vector.created' group by all", "event_log"),
    "h2_replay_seed_assignments": sql("select session_id, k % 4 as sample_idx, max_by(k, sequence) as core, max_by(k % 7, sequence) as \"unique\" from aux_log where event_type = 'seed.assigned' group by all", "aux_log"),
    "h3_apply_rollback": sql("select session_id, count(*) as n, sum(sequence) as sequences from event_log where sequence % 20 <> 0 group by 1", "event_log"),
    "h3_apply_rollback_honored": sql(
        "m as (select session_id, sequence as s from event_log where sequence % 20 = 0) select e.session_id, count(*) as n, sum(e.sequence) as sequences from event_log e where sequence % 20 <> 0 and not exists (select 1 from m where m.session_id = e.session_id and e.sequence > s - 5 and e.sequence < s) group by 1", "event_log"
    ),
    "h4_agent_rollup": sql(
        """o as (select session_id, k % 4 as n, max_by(k, sequence) as k, printf('%.4f', round(max_by(value, sequence), 2)) as loss from event_log where event_type = 'optimization.completed' group by all),
        s as (select session_id, k % 4 as n, max_by(k, sequence) as core, max_by(k % 7, sequence) as uniq from aux_log where event_type = 'seed.assigned' group by all)
        select session_id, 'sample_' || n as agent, 'sample' as kind, 'Sample ' || (n + 1) as name, case when k is null then core || ' core + ' || uniq || ' unique' else 'L' || (k % 8) || ' iters=0' end as role,
          case when k % 2 = 1 then 'error' else 'complete' end as status, k % 8 as layer, case when k is not null then 0 end as iterations, core + uniq as pairs, 1 as turns, 1 as messages, coalesce(core + uniq, 0) as tool_calls,
          case when k is null then 'Assigned ' || core || ' core + ' || uniq || ' unique seeds (' || (core + uniq) || ' total pairs)' when k % 2 = 1 then 'Optimization failed: Unknown error'
            else 'Optimization complete: loss=' || loss || ', 0 iterations in 0.0s' end as message
        from o full join s using (session_id, n)
        union all
        select session_id, source, 'source', upper(source[1]) || source[2:], source, 'complete', null, null, null, count(*) filter (where event_type = 'llm.request'),
          count(*) filter (where case event_type when 'llm.request' then k % 3 = 1 or k % 3 = 2 and k % 7 <> 0 else k % 4 <> 0 or k % 5 = 0 end), count(*) filter (where event_type = 'llm.response' and k % 5 = 0), null
        from event_log where event_type like 'llm.%' group by all""",
        "event_log", "aux_log",
    ),
    "h5_session_overview": sql(
        f"""{_STATE}, l as (select session_id, max_by(k, sequence) as k from event_log where event_type = 'evaluation.completed' group by 1)
        select m.session_id, coalesce(nullif(f.behavior_name, ''), m.behavior) as behavior, case m.status when 'completed' then 'complete' when 'failed' then 'failed' else 'running' end as shown_status, 'initializing' as shown_phase,
          coalesce(f.progress, 0) as progress, best_layer, 1.0 as best_strength, coalesce(best_score, 0) as overall, coalesce(datapoints, 0) as datapoints, coalesce(l.k % 11 / 10.0, 0) as behavior_score,
          coalesce(l.k % 13 / 10.0, 0) as coherence_score, 0.0 as specificity_score, case when l.k % 4 = 1 then 'accepted' when l.k is not null then 'needs_refinement' end as verdict
        from session_metadata m left join full_state f using (session_id) left join l using (session_id)""",
        "event_log", "session_metadata",
    ),
    "h6_event_logs": sql(f"{_LINES} select session_id, sequence, message from lines qualify row_number() over (partition by session_id order by sequence desc) <= 20", "event_log"),
}
