"""Queries on judge output, artifacts, inference flows and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from contrail.fixtures import candidate_vectors, event_log, judgements, pair_scores, pairs, read, seeds, session_metadata, sql
from contrail.functions import judge_output as g
from contrail.operators import pairs as p
from contrail.operators import replay
from contrail.plans import inference as inf
from contrail.queries.events import ORACLE as EVENTS
from contrail.queries.events import session_logs, written_log
from contrail.queries.vectors import exploded, rounded
from contrail.sources import artifacts as art
from contrail.sources.events import read_events
from contrail.sources.live_logs import stream_events
from contrail.sources.scratch import FOLDERS, shared_folder
from contrail.streaming import ordered as live
from contrail.streaming import sessions as st


def judge_raw(s, d):
    """Judge answers of (vec_id, item_id, generation) in five shapes, one in eleven with a result too few; n results are due."""
    rows = judgements(s, d).groupBy("sample_idx", "item_id", "generation_index").agg(F.sort_array(F.collect_list(F.struct("strength", "score"))).alias("a"), F.count("*").alias("n"))
    few = F.when(F.pmod(F.col("sample_idx") + F.col("item_id"), F.lit(11)) == 0, F.slice("a", F.lit(1), F.col("n").cast("int") - 1)).otherwise(F.col("a"))
    body = F.to_json(F.transform(few, lambda x: F.struct(x["score"].alias("score"), F.lit("r").alias("reasoning"))))
    wrapped = F.concat(F.lit('{"results": '), body, F.lit("}"))
    text = (
        F.when(F.col("sample_idx") % 5 == 0, wrapped).when(F.col("sample_idx") % 5 == 1, body).when(F.col("sample_idx") % 5 == 2, F.concat(F.lit("Sure:\n```json\n"), wrapped, F.lit("\n```\nDone.")))
        .when(F.col("sample_idx") % 5 == 3, F.concat(F.lit("The scores are "), body, F.lit(" as asked."))).otherwise(F.concat(F.lit("{broken "), F.col("sample_idx").cast("string")))
    )
    return rows.select("sample_idx", "item_id", "generation_index", text.alias("text"), F.col("n").cast("int").alias("n"))


def _scores(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id", "case doc_id % 4 when 0 then concat('{\"score\": ', doc_id % 11, '}') when 1 then concat('```json\\n{\"score\": ', doc_id % 7, '.5}\\n```') when 2 then concat('I give ', 20 + doc_id, ' or rather ', doc_id % 9, ' points') else 'no idea' end as text")
    return rows.select("doc_id", g.extract_score(F.col("text")).alias("score"))


def _parsed(s, d):
    return judge_raw(s, d).select("sample_idx", "item_id", "generation_index", F.md5(g.parse_llm_json(F.col("text"))).alias("json_md5"))


def _answers(s, d):
    return read(s, d, "documents").selectExpr("doc_id", "lang", "source", "if(doc_id % 7 = 6, 'no json', to_json(named_struct('dimension_check', named_struct('score', doc_id % 11), 'marker_check', named_struct('score', doc_id % 10), 'structural_check', named_struct('score', 5 + doc_id % 6), 'overall', named_struct('contrast_quality', doc_id % 9, 'primary_issue', if(doc_id % 3 = 0, 'none', 'weak'), 'reasoning', lang)))) as text")


def _validation(s, d):
    return g.build_validation(_answers(s, d), "text").select("doc_id", "dimension", "marker", "boundary", "intensity_score", "structural", "contrast_quality", "is_valid", "reasoning")


def _signal(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id", "if(doc_id % 5 = 0, 'none', to_json(named_struct('signal_strength', doc_id % 11, 'dst_strength', doc_id % 7, 'length_similar', doc_id % 2 = 0))) as text")
    return g.build_signal_results(rows, "text").drop("text")


def _listing(name: str, item: str):
    def run(s, d, explode):
        return explode(read(s, d, "documents").selectExpr("doc_id", f"concat('{{\"{name}\": [', {item}, ', 5, {{\"other\": 1}}]}}') as text"), "text").drop("text")

    return run


_SEEDS = _listing("scenarios", "to_json(named_struct('scenario', source, 'context', lang, 'expected_contrast_strength', if(doc_id % 2 = 0, doc_id % 10, null), 'target_components', array('a', lang)))")
_COMPONENTS = _listing("components", "to_json(named_struct('name', if(doc_id % 4 = 0, '', source), 'description', lang, 'markers', array('m1', 'm2')))")
_CONFOUNDS = _listing("confounds_to_avoid", "if(doc_id % 2 = 0, concat('\"', source, '\"'), to_json(named_struct('factor', lang)))")
_NEGATIVES = _listing("not_this_behavior", "to_json(named_struct('similar_behavior', source, 'why_different', lang, 'example', if(doc_id % 5 = 0, null, concat('ex', doc_id))))")
_SCENARIOS = _listing("realistic_scenarios", "to_json(named_struct('setup', source, 'user_persona', lang, 'natural_trigger', concat('t', doc_id % 3)))")
_EVAL = _listing("prompts", "to_json(named_struct('prompt', if(doc_id % 6 = 0, 'A user asking about x', concat(' ', source, ' ')), 'category', if(doc_id % 2 = 0, lang, null)))")
_COMPLETIONS = _listing("completions", "to_json(named_struct('prompt', source, 'dst_completion', lang, 'src_completion', if(doc_id % 5 = 0, null, 'y')))")


def _batches(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id as pos", "if(doc_id % 13 = 0, null, source) as prompt", "lang as output")
    out = g.judge_batches(rows, size=64)
    return out.select("batch_key", "n", F.element_at("outputs", 1)["pos"].alias("first_pos"), F.array_join(F.transform("outputs", lambda o: o["output"]), ",").alias("outputs"))


def upper_client():
    """A deterministic stand-in for a model: a JSON answer made of the prompt's length and words."""
    return lambda prompts: [json.dumps({"score": len(x) % 11, "prompt": x[10:14], "dst_response": f"d{len(x)}", "src_response": f"s{len(x) % 3}"}) for x in prompts]


def _infer(s, d, clip=None):
    rows = read(s, d, "documents").select("doc_id", "text", "lang")
    out = inf.batch_infer(rows, upper_client, "{lang}: {text}", clip=clip)
    return out.select("doc_id", F.get_json_object("response", "$.score").cast("int").alias("score"), "error")


def _generate(s, d):
    rows = seeds(s, d).select("pos", "scenario", "context", F.lit("high").alias("intensity"))
    return inf.generate_pairs(rows, upper_client, "{scenario} {context}").select("pos", "dst", "src", "temperature", "error")


def _retry(s, d):
    rows = pairs(s, d).select("pair_id", F.concat("scenario", F.col("pair_id").cast("string")).alias("dst"), F.lit("x").alias("src"))
    validate = lambda df: df.withColumn("contrast_quality", F.length("dst").cast("double")).withColumn("is_valid", F.length("dst") % 3 == 0)
    regenerate = lambda df: df.withColumn("dst", F.concat("dst", F.lit("+"))).withColumn("src", F.lit(""))
    return inf.validate_with_retry(rows, validate, regenerate, 1)


def _flow(s, d):
    table = seeds(s, d).select("pos", "scenario", "context", "target_components", "quality_score", "attributes")
    validate = lambda df: df.withColumn("contrast_quality", F.col("pos") % 10 + 0.0).withColumn("is_valid", F.col("pos") % 4 != 0)
    shares = {"extreme": 0.1, "high": 0.2, "medium": 0.3, "natural": 0.4}
    sets, _ = inf.build_contrast_datasets(table, upper_client, validate, lambda df: df, 80, 8, 10, shares)
    return sets.groupBy("sample_idx", "pool").agg(F.count("*").alias("n"), F.sum("pair_id").alias("ids"))


def number_client():
    return lambda prompts: [json.dumps({"results": [{"score": float(x)} for x in p.split("\n")[1:]]}) for p in prompts]


def _evaluate(s, d):
    out = judgements(s, d).selectExpr("sample_idx * 4294967296 + item_id * 15 + cast(strength * 6 as int) - 3 + generation_index as pos", "sample_idx", "dimension", "concat('p', item_id) as prompt", "cast(score as string) as output", "strength")
    return rounded(inf.evaluate_candidates(out, number_client), "overall")


def _attach(s, d, generated="false"):
    """Scenarios and triggers are the distinct languages of all documents, domains the sources, each at its first doc_id."""
    docs = read(s, d, "documents")
    named = lambda c, name="prompt": docs.where(f"{c} is not null").groupBy(F.expr(c).alias(name)).agg(F.min("doc_id").alias("pos"))
    return inf.attach_eval_prompts(docs.where(generated).selectExpr("doc_id as pos", "text as prompt"), named("lang"), named("upper(lang)"), named("source", "domain"), ["Tell me about {domain}", "Why {domain}?"], 20)


def _reduce(s, d):
    return exploded(inf.reduce_vectors(candidate_vectors(s, d), ["label"], lambda x: x.max(axis=0)), "label")


def _refs(s, d):
    rows = replay.vectors_created(event_log(s, d)).withColumn("vector", F.array(F.col("layer").cast("double")))
    path = shared_folder(s, "vectors")
    art.save_vectors(rows, path, FOLDERS)
    return art.load_vectors(s, path).select(F.col("session_id").cast("string").alias("session_id"), "sequence", "version", "vector_ref")


def _task(s, d):
    path = shared_folder(s, "task")
    rows = candidate_vectors(s, d).select((F.col("pos") % 4).alias("task_id"), "sample_idx", F.when(F.col("is_valid"), F.col("overall_score")).alias("score"))
    art.save_task_result(path, {"samples": rows})
    return art.load_task_result(s, path, ["samples"], 2)["samples"].select("sample_idx", "score")


def _json(s, d):
    text = art.datapoints_to_json(pair_scores(s, d), ["contrast_quality", "intensity"])
    back = art.datapoints_from_json(text)
    return back.select("pair_id", "prompt", F.md5(F.col("dst_completions")[0]).alias("dst_md5"), F.get_json_object("metadata", "$.contrast_quality").cast("double").alias("quality"))


def _serialize(s, d):
    rows = art.serialize_sample_datasets(pair_scores(s, d), list(p.SCORES))
    exported = rows.where(F.get_json_object("json", "$.weakest").isNotNull()).groupBy("sample_idx").agg(F.count("*").alias("exported"))
    return rounded(art.sample_dataset_summary(pair_scores(s, d)).join(exported, "sample_idx", "left").na.fill(0, ["exported"]), "avg_quality")


def _serialized(s, d):
    rows = art.serialize_sample_datasets(pair_scores(s, d), list(p.SCORES))
    return rows.select("sample_idx", "pair_id", F.get_json_object("json", "$.dimension").cast("double").alias("dimension"), F.get_json_object("json", "$.marker").cast("double").alias("marker"))


def _tasks(s, d):
    """Five tables of every task, saved, loaded and rolled up."""
    path = shared_folder(s, "tasks")
    rows = candidate_vectors(s, d).withColumn("task_id", F.col("pos") % 40)
    ids = rows.select("task_id").distinct()
    art.save_task_result(
        path,
        {
            "task": ids.withColumn("status", F.when(F.col("task_id") % 3 == 0, "failed").otherwise("done")),
            "behavior": ids.withColumn("name", F.concat(F.lit("b"), F.col("task_id") % 5)),
            "pairs": pair_scores(s, d).select((F.col("pair_id") % 40).alias("task_id"), "pair_id", "is_valid"),
            "samples": rows.select("task_id", "sample_idx", F.when(F.col("is_valid"), F.col("overall_score")).alias("score")),
            "losses": rows.select("task_id", "sample_idx", F.posexplode(F.expr("transform(sequence(1, 3), i -> ((sample_idx * i) % 97) / cast(97 as double))")).alias("step", "loss")),
        },
    )
    tables = art.load_task_result(s, path, ["task", "behavior", "pairs", "samples", "losses"])
    return rounded(art.task_summary(tables), "last_loss")


def _analysis(body: str, take):
    def run(s, d):
        return take(read(s, d, "documents").selectExpr("doc_id", f"to_json({body}) as text"), "text").drop("text")

    return run


_TEST = _analysis("named_struct('behavioral_test', named_struct('distinguishing_variable', if(doc_id % 4 = 0, '', source), 'description', lang))", g.behavioral_test)
_CALIBRATION = _analysis("named_struct('intensity_calibration', named_struct('extreme_looks_like', if(doc_id % 3 = 0, null, source), 'high_looks_like', ''))", g.intensity_calibration)


def _streamed(name, transform, mode="append", clock=False):
    def run(s, d):
        stream = stream_events(s, session_logs(s, d, f"{name}-log", clock), shared_folder(s, f"{name}-positions"), "*.txt")
        return st.run_available(transform(stream), shared_folder(s, f"{name}-out"), shared_folder(s, f"{name}-checkpoint"), mode)

    return run


def _latest(out):
    """Each session's row of its last trigger."""
    columns = [c for c in out.columns if c not in ("session_id", "batch_id")]
    return out.groupBy("session_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("x")).select("session_id", "x.*")


def _stream_state(s, d):
    out = _latest(_streamed("state", live.stream_session_state, "update")(s, d))
    return rounded(out.select("session_id", "status", "phase", "progress", "best_layer", "overall", "llm_calls"), "overall", "progress")


def _stream_progress(s, d):
    planned = session_metadata(s, d).select("session_id", (F.col("event_count") / 5).cast("long").alias("total"))
    return rounded(_latest(_streamed("progress", lambda e: live.stream_progress(e, planned), "update")(s, d)), "elapsed", "rate", "share", "remaining", places=4)


QUERIES = {
    "g1_parse_llm_json": _parsed,
    "g2_extract_score": _scores,
    "g3_explode_judge_results": lambda s, d: g.explode_judge_results(judge_raw(s, d), "text", "n").drop("text", "n"),
    "g4_build_validation": _validation,
    "g5_build_signal_results": _signal,
    "g6_explode_seeds": lambda s, d: _SEEDS(s, d, g.explode_seeds).withColumn("target_components", F.array_join("target_components", ",")),
    "g7_explode_components": lambda s, d: _COMPONENTS(s, d, g.explode_components).withColumn("markers", F.array_join("markers", ",")),
    "g7_explode_confounds": lambda s, d: _CONFOUNDS(s, d, g.explode_confounds),
    "g7_explode_negatives": lambda s, d: _NEGATIVES(s, d, g.explode_negatives),
    "g7_explode_scenarios": lambda s, d: _SCENARIOS(s, d, g.explode_scenarios),
    "g7_behavioral_test": lambda s, d: _TEST(s, d).select("doc_id", "description", "distinguishing_variable", "user_action"),
    "g7_intensity_calibration": _CALIBRATION,
    "g7_short_name": lambda s, d: read(s, d, "documents").select("doc_id", g.short_name(F.coalesce("text", F.lit(""))).alias("name")),
    "g8_explode_eval_prompts": lambda s, d: _EVAL(s, d, g.explode_eval_prompts),
    "g9_explode_completions": lambda s, d: _COMPLETIONS(s, d, g.explode_completions).select("doc_id", "at", "prompt", F.col("dst_completions")[0].alias("dst"), F.col("src_completions")[0].alias("src")),
    "d29_judge_batches": _batches,
    "a9_vector_refs": _refs,
    "a10_task_result": _task,
    "a11_datapoints_json": _json,
    "a10_task_result_whole": _tasks,
    "a12_serialize_samples": _serialize,
    "a12_serialize_pairs": _serialized,
    "i1_batch_infer": lambda s, d: _infer(s, d, {"text": 100}),
    "i1_batch_infer_whole": _infer,
    "i2_generate_pairs": _generate,
    "i3_validate_with_retry": _retry,
    "i4_reduce_vectors": _reduce,
    "i5_build_contrast_datasets": _flow,
    "i6_evaluate_candidates": _evaluate,
    "c12_attach_eval_prompts": _attach,
    "c12_attach_eval_prompts_generated": lambda s, d: _attach(s, d, "text is not null"),
    "h7_stream_events": lambda s, d: _streamed("events", lambda e: e)(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("sequence").alias("sequences")),
    "h8_stream_session_state": _stream_state,
    "h9_stream_llm_pairs": lambda s, d: rounded(_streamed("pairs", live.stream_llm_pairs, clock=True)(s, d), "seconds", places=3),
    "h10_stream_progress": _stream_progress,
    "h11_stream_logs": _streamed("logs", st.stream_logs),
    "h7_batch_events": lambda s, d: read_events(s, written_log(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
}

_RAW = "raw as (select sample_idx, item_id, generation_index, s, score, sample_idx % 5 = 4 as broken, (sample_idx + item_id) % 11 = 0 and s = 5 as missing from (select *, (strength * 2)::int as s from judgements))"
_TRIM = "trim(coalesce(text, ''), ' ')"
ORACLE = {
    "g1_parse_llm_json": sql(
        """b as (select sample_idx, item_id, generation_index, '[' || string_agg('{"score":' || score::varchar || ',"reasoning":"r"}', ',' order by strength) filter (where (sample_idx + item_id) % 11 <> 0 or strength < 2.5) || ']' as body from judgements group by all)
        select sample_idx, item_id, generation_index, case sample_idx % 5 when 1 then md5(body) when 0 then md5('{"results": ' || body || '}') when 2 then md5('{"results": ' || body || '}' || chr(10)) end as json_md5 from b""",
        "judgements",
    ),
    "g2_extract_score": "select doc_id, case doc_id % 4 when 0 then doc_id % 11 when 1 then doc_id % 7 + 0.5 when 2 then doc_id % 9 else 5 end::double as score from documents",
    "g3_explode_judge_results": sql(
        f"{_RAW} select sample_idx, item_id, generation_index, s - 1 as output_index, case when broken or missing then 5 else score end as score, case when broken then 'Parse error' when missing then 'Parse incomplete' else 'r' end as reasoning, broken or missing as is_default from raw", "judgements"
    ),
    "g4_build_validation": """with x as (select doc_id, lang, doc_id % 7 = 6 as bad from documents), y as (select doc_id, lang, bad, case when bad then 5 else doc_id % 11 end::double as dimension, case when bad then -1 else doc_id % 10 end::double as marker, -1.0::double as boundary, 5.0::double as intensity_score,
        case when bad then 10 else 5 + doc_id % 6 end::double as structural, case when bad then 5 else doc_id % 9 end::double as contrast_quality from x)
        select doc_id, dimension, marker, boundary, intensity_score, structural, contrast_quality, dimension >= 6 and structural >= 7 and (marker < 0 or marker >= 5) as is_valid,
        concat_ws(' | ', 'Dim:' || dimension::int, 'Struct:' || structural::int, case when marker >= 0 then 'Mark:' || marker::int end, 'Int:5', case when not bad and doc_id % 3 <> 0 then 'Issue: weak' end, case when not bad then lang end) as reasoning from y""",
    "g5_build_signal_results": """select doc_id, case when doc_id % 5 = 0 then 5 else doc_id % 11 end::double as signal_strength, case when doc_id % 5 = 0 then 5 else doc_id % 7 end::double as dst_strength, 5.0::double as src_strength, 5.0::double as confound_score,
        case when doc_id % 5 = 0 then true else doc_id % 2 = 0 end as length_similar, true as style_similar from documents""",
    "g6_explode_seeds": "select doc_id, 0 as at, source as scenario, lang as context, case when doc_id % 2 = 0 then doc_id % 10 else 7 end::double as expected_contrast_strength, case when doc_id % 2 = 0 then doc_id % 10 else 7 end::double as quality_score, 'a,' || lang as target_components from documents",
    "g7_explode_components": "select doc_id, 0 as at, source as name, lang as description, 'm1,m2' as markers from documents where doc_id % 4 <> 0",
    "g7_explode_confounds": "select doc_id, 0 as at, case when doc_id % 2 = 0 then source else lang end as factor from documents union all select doc_id, 1, '5' from documents",
    "g7_explode_negatives": "select doc_id, 0 as at, coalesce(source, '') as name, coalesce(lang, '') as why, case when doc_id % 5 = 0 then '' else 'ex' || doc_id end as example from documents union all select doc_id, 2, '', '', '' from documents",
    "g7_explode_scenarios": "select doc_id, 0 as at, coalesce(source, '') as setup, coalesce(lang, '') as user_persona, 't' || (doc_id % 3) as natural_trigger, '' as stakes from documents union all select doc_id, 2, '', '', '', '' from documents",
    "g7_behavioral_test": "select doc_id, coalesce(lang, '') as description, source as distinguishing_variable, '' as user_action from documents where doc_id % 4 <> 0 and source <> ''",
    "g7_intensity_calibration": "select doc_id, source as extreme, '' as high, 'Balanced expression' as medium, 'Subtle, realistic expression' as natural from documents where doc_id % 3 <> 0 and source <> ''",
    "g7_short_name": f"with x as (select doc_id, trim(split_part(coalesce(text, ''), '.', 1), ' ') as n from documents) select doc_id, case when length(n) > 50 then n[:47] || '...' else n end as name from x",
    "g8_explode_eval_prompts": "select doc_id, 0 as at, source as prompt, case when doc_id % 2 = 0 then lang else 'general' end as category, 'medium' as expected_intensity from documents where doc_id % 6 <> 0",
    "g9_explode_completions": "select doc_id, 0 as at, source as prompt, lang as dst, 'y' as src from documents where doc_id % 5 <> 0",
    "d29_judge_batches": """with k as (select coalesce(case when doc_id % 13 <> 0 then source end, 'unknown') as batch_key, doc_id, lang from documents), b as (select *, (row_number() over (order by batch_key, doc_id) - 1) // 64 as b from k)
        select batch_key, count(*) as n, min(doc_id) as first_pos, string_agg(lang, ',' order by doc_id) as outputs from b group by batch_key, b""",
    "a9_vector_refs": sql("v as (select session_id, sequence, k % 8 as layer, row_number() over (partition by session_id, k % 8 order by sequence) as version from event_log where event_type = 'vector.created') select session_id, sequence, version, printf('vectors/layer_%02d_v%03d.pt', layer, version) as vector_ref from v", "event_log"),
    "a10_task_result": sql("select sample_idx, overall_score as score from candidate_vectors where pos % 4 = 2 and is_valid", "candidate_vectors"),
    "a10_task_result_whole": sql(
        """s as (select pos % 40 as task_id, count(*) filter (where is_valid) as samples, max(overall_score) filter (where is_valid) as best_score, count(*) * 3 as losses, round(avg((sample_idx * 3) % 97 / 97.0::double), 6) as last_loss from candidate_vectors group by 1),
        q as (select pair_id % 40 as task_id, count(*) as pairs, count(*) filter (where is_valid) as valid_pairs from pair_scores group by 1)
        select task_id, case when task_id % 3 = 0 then 'failed' else 'done' end as status, 'b' || (task_id % 5) as behavior, samples, best_score, coalesce(pairs, 0) as pairs, coalesce(valid_pairs, 0) as valid_pairs, losses, last_loss from s left join q using (task_id)""",
        "candidate_vectors", "pair_scores",
    ),
    "a12_serialize_pairs": sql("select sample_idx, pair_id, case when dimension >= 0 then dimension end as dimension, case when marker >= 0 then marker end as marker from pair_scores where is_valid", "pair_scores"),
    "c12_attach_eval_prompts": """with a as (select lang as prompt, 1 as origin, min(doc_id) as pos from documents where lang is not null group by lang union all select upper(lang), 2, min(doc_id) from documents where lang is not null group by upper(lang)),
        n as (select source as domain, min(doc_id) as pos from documents where source is not null group by 1), g as (select 'Tell me about ' || domain as prompt, 3 as origin, pos * 2 as pos from n union all select 'Why ' || domain || '?', 3, pos * 2 + 1 from n)
        select * from (select * from a union all select * from g) order by origin, pos limit 20""",
    "c12_attach_eval_prompts_generated": "select text as prompt, 0 as origin, doc_id as pos from documents where text is not null order by doc_id limit 20",
    "i5_build_contrast_datasets": sql(
        """o as (select pos, scenario, context, quality_score, row_number() over (order by pos) <= 80 as core from seeds), r as (select *, row_number() over (partition by core order by quality_score desc, pos) - 1 as i, count(*) over (partition by core) as n from o),
        a as (select core, t.s as sample_idx, pos, scenario, context from r, range(0, 8) t(s) where (i - t.s * n // 8 + n) % n < 10),
        x as (select distinct a.sample_idx, 'core' as pool, o.pos as pair_id from a join o on o.core and o.scenario = a.scenario and o.context = a.context where a.core union all select sample_idx, 'unique', pos from a where not core)
        select sample_idx, pool, count(*) as n, sum(pair_id) as ids from x group by all""",
        "seeds",
    ),
    "a11_datapoints_json": sql("select pair_id, prompt, md5(dst) as dst_md5, contrast_quality as quality from pair_scores", "pair_scores"),
    "a12_serialize_samples": sql("select sample_idx, count(*) as total, count(*) filter (where is_valid) as valid, round(coalesce(avg(contrast_quality) filter (where is_valid), 0), 6) as avg_quality, count(*) filter (where is_valid) as exported from pair_scores group by 1", "pair_scores"),
    "i1_batch_infer_whole": "select doc_id, length(lang || ': ' || coalesce(text, '')) % 11 as score, null::varchar as error from documents",
    "i1_batch_infer": "select doc_id, length(lang || ': ' || coalesce(text, '')[:100]) % 11 as score, null::varchar as error from documents",
    "i2_generate_pairs": sql("select pos, 'd' || length(scenario || ' ' || context) as dst, 's' || length(scenario || ' ' || context) % 3 as src, 0.8::double as temperature, null::varchar as error from seeds", "seeds"),
    "i3_validate_with_retry": sql("x as (select pair_id, scenario || pair_id as w, length(scenario || pair_id) as l from pairs) select pair_id, case when l % 3 = 0 then w else w || '+' end as dst, 'x' as src, (case when l % 3 = 0 then l else l + 1 end)::double as contrast_quality, l % 3 in (0, 2) as is_valid, case when l % 3 = 0 then 1 else 2 end as attempts from x", "pairs"),
    "i4_reduce_vectors": sql("select label, i - 1 as dim, round(max(vector[i]), 6) as x from candidate_vectors, range(1, 65) t(i) group by all", "candidate_vectors"),
    "i6_evaluate_candidates": sql(
        "dims as (select sample_idx, dimension, avg(score) as s from judgements group by all), o as (select sample_idx, sum(s / 10 * case dimension when 'behavior' then 0.3 when 'specificity' then 0.25 when 'coherence' then 0.2 else 0.1 end) as o from dims group by 1) select sample_idx, round(o, 6) as overall, case when o > 0.5 then 'passed' else 'needs_refinement' end as verdict from o",
        "judgements",
    ),
    "h7_stream_events": sql("select session_id, count(*) as n, sum(sequence) as sequences from event_log group by 1", "event_log"),
    "h7_batch_events": sql("select session_id, count(*) as n from event_log group by 1", "event_log"),
    "h8_stream_session_state": sql(
        """st as (select session_id, min(sequence) as s from event_log where event_type = 'session.started' group by 1), e as (select l.*, st.s from event_log l left join st using (session_id)), x as (select *, sequence > s as live from e)
        select session_id, case when any_value(s) is null then '' else 'running' end as status,
        coalesce(max_by(case event_type when 'vector.created' then 'optimizing' when 'evaluation.completed' then 'review' when 'session.started' then 'initializing' end, sequence) filter (where (live and event_type in ('vector.created', 'evaluation.completed')) or sequence = s), '') as phase,
        coalesce(max(case event_type when 'vector.created' then 0.5 when 'evaluation.completed' then 0.9 end) filter (where live), 0) as progress, max_by(k % 8, sequence) filter (where live and event_type = 'vector.selected') as best_layer,
        round(coalesce(max_by(round(value / 100, 4), sequence) filter (where live and event_type = 'evaluation.completed'), 0), 6) as overall, count(*) filter (where live and event_type = 'llm.response') as llm_calls from x group by 1""",
        "event_log",
    ),
    "h9_stream_llm_pairs": EVENTS["c1_pair_llm_calls"],
    "h10_stream_progress": EVENTS["d33_progress"],
    "h11_stream_logs": EVENTS["g10_log_line"],
}
