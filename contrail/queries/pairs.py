"""Queries on pairs and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.fixtures import candidate_vectors, pair_scores, pair_vectors, pairs, read, seeds, sql
from contrail.operators import pairs as p
from contrail.queries.vectors import rounded
from contrail.sources.events import new_sessions


def _merge(s, d):
    df = pair_scores(s, d)
    shift = lambda c: F.when(F.col("pair_id") % 4 == 0, F.lit(-1.0)).otherwise(F.greatest(F.col(c) - 1, F.lit(0.0)))
    cur = F.struct("is_valid", "contrast_quality", *p.SCORES, F.when(F.col("pair_id") % 2 == 0, F.lit("a")).otherwise("").alias("reasoning"))
    new = F.struct((F.col("structural") > 3).alias("is_valid"), F.col("semantic").alias("contrast_quality"), *(shift(c).alias(c) for c in p.SCORES), F.lit("b").alias("reasoning"))
    out = p.merge_validations(df.select("pair_id", cur.alias("cur"), new.alias("new"))).select("pair_id", "merged.*")
    return rounded(out, "contrast_quality", *p.SCORES)


def _chain(s, d):
    df = pair_scores(s, d).drop("is_valid", "contrast_quality").join(p.semantic_distance(pair_vectors(s, d), "dst_vec", "src_vec", 0.9).select("pair_id", "semantic_score", "semantic_valid"), "pair_id")
    stages = [
        ("embedding", lambda x: x.withColumn("stage_valid", F.col("semantic_valid")).withColumn("stage_quality", F.col("semantic_score"))),
        ("judge", lambda x: p.gate_pairs(x).withColumnRenamed("gate", "stage_valid").withColumn("stage_quality", F.col("dimension"))),
    ]
    return rounded(p.validate_chain(df, stages).select("pair_id", "is_valid", "contrast_quality", "failed_stage"), "contrast_quality")


def _guidance(s, d):
    df = pair_scores(s, d).withColumns(
        {
            "dimension_detail": F.when(F.col("pair_id") % 3 == 0, F.lit("flat")),
            "marker_detail": F.when(F.col("pair_id") % 2 == 0, F.array(F.lit("m1"), F.lit("m2"), F.lit("m3"), F.lit("m4"))),
            "boundary_detail": F.when(F.col("pair_id") % 4 == 0, F.lit("irony")),
            "intensity_detail": F.lit(None).cast("string"),
        }
    )
    return p.improvement_guidance(df).select("pair_id", "guidance")


def _assignments(s, d):
    return seeds(s, d).selectExpr("cast(pos % 16 as int) as sample_idx", "scenario", "context", "target_components", "pos")


def _prompts(s, d):
    return read(s, d, "documents").selectExpr("doc_id as pos", "if(doc_id % 20 = 0, concat('A user asking about ', text), text) as prompt")


def _boundary(s, d):
    rows = pairs(s, d).selectExpr("pair_id", "upper(scenario) as confused_with")
    negatives = read(s, d, "documents").selectExpr("doc_id as pos", "source as name", "concat('ex', doc_id) as example")
    return p.boundary_feedback(rows, negatives)


def _select(preset):
    return lambda s, d: p.select_pairs_for_extraction(pair_scores(s, d), preset).select("pair_id", "sample_idx")


QUERIES = {
    "b1_valid_pairs": lambda s, d: p.valid_pairs(pair_scores(s, d)).select("pair_id", "contrast_quality"),
    "b2_gate_pairs": lambda s, d: p.gate_pairs(pair_scores(s, d), F.col("pair_id") % 2 == 0, F.col("pair_id") % 3 == 0).select("pair_id", "gate"),
    "b4_signal_gate": lambda s, d: p.signal_gate(pair_scores(s, d)).select("pair_id", "signal_valid", "contrast_quality"),
    "b5_length_ratio": lambda s, d: rounded(p.length_ratio(pairs(s, d)).select("pair_id", "dst_words", "src_words", "ratio", "ratio_ideal"), "ratio"),
    "b6_merge_validations": _merge,
    "b7_validate_chain": _chain,
    "b8_score_extremes": lambda s, d: p.score_extremes(pair_scores(s, d)).select("pair_id", F.array_join("evaluated", ",").alias("evaluated"), "weakest", "strongest"),
    "b9_improvement_guidance": _guidance,
    "b10_filter_by_intensity": lambda s, d: p.filter_by_intensity(pairs(s, d), "high_signal").select("pair_id", "intensity"),
    "b11_filter_by_confound": lambda s, d: p.filter_by_confound(pair_scores(s, d), 5).select("pair_id", "confound"),
    "b12_filter_by_signal": lambda s, d: p.filter_by_signal(pair_scores(s, d), "top_k", top_k=5).select("pair_id", "sample_idx"),
    **{f"b13_select_{x}": _select(x) for x in p.PRESETS},
    "b14_diversity_flags": lambda s, d: p.diversity_flags(pairs(s, d), 3, True),
    "b15_drop_description_prompts": lambda s, d: p.drop_description_prompts(_prompts(s, d)).select("pos"),
    "b18_filter_samples": lambda s, d: p.filter_samples(candidate_vectors(s, d).withColumn("name", F.concat(F.lit("s"), "sample_idx")), "middle", name_contains="1").select("sample_idx"),
    "c6_sample_datasets": lambda s, d: p.sample_datasets(pairs(s, d), _assignments(s, d)),
    "c13_boundary_feedback": _boundary,
    "d7_pool_statistics": lambda s, d: rounded(p.pool_statistics(pair_scores(s, d)), "core_quality", "avg_pairs", "avg_quality"),
    "d8_pipeline_totals": lambda s, d: rounded(p.pipeline_totals(pair_scores(s, d)), "avg_quality"),
    "d9_seed_summary": lambda s, d: rounded(p.seed_summary(seeds(s, d), 80), "avg_quality"),
    "d10_component_coverage": lambda s, d: rounded(p.component_coverage(_assignments(s, d), seeds(s, d).select(F.explode("target_components").alias("component"))), "coverage"),
    "e2_top_pairs": lambda s, d: p.top_pairs(pair_scores(s, d), 3, ["sample_idx"]).select("sample_idx", "pair_id", "contrast_quality"),
    "e6_dedup_prompts": lambda s, d: _dedup(s, d),
    "f1_all_pairs": lambda s, d: p.all_pairs(pairs(s, d).where("sample_idx = -1"), pairs(s, d).where("sample_idx >= 0")).groupBy("pool").agg(F.count("*").alias("n"), F.sum("pair_id").alias("ids")),
    "f2_distinct_seeds": lambda s, d: p.distinct_seeds(seeds(s, d)).select("scenario", "context", "pos"),
    "f3_new_sessions": lambda s, d: new_sessions(seeds(s, d), seeds(s, d).where("pos % 7 = 0"), "context"),
    "f4_split_seeds": lambda s, d: p.split_seeds(seeds(s, d), 80).select("pos", "is_core"),
    "g16_pair_to_datapoint": lambda s, d: p.pair_to_datapoint(pair_scores(s, d)).selectExpr("pair_id", "prompt", "md5(dst_completions[0]) as dst", "size(src_completions) as n"),
}


def _dedup(s, d):
    from contrail.operators.diversity import dedup_prompts

    return dedup_prompts(_prompts(s, d)).select("pos")


_MERGED = ",\n".join(
    f"round(case when pair_id % 4 <> 0 then greatest({c} - 1, 0) else {c} end, 6) as {c}" for c in ("dimension", "marker", "boundary", "intensity_score", "structural", "semantic", "behavioral_signal", "confound")
)
_GATE = "dimension >= 6 and structural >= 7 and ({m} or marker < 0 or marker >= 5) and ({b} or boundary < 0 or boundary >= 5)"
_SIGNAL = "case when behavioral_signal >= 0 then behavioral_signal else contrast_quality end"
_WORDS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda x: x <> ''))"
_LONG = " union all ".join(f"select pair_id, {c} as v, {i} as o, '{c}' as name from pair_scores" for i, c in enumerate(p.SCORES))
_ASSIGN = "assignments as (select pos % 16 as sample_idx, scenario, context, target_components, pos from seeds)"
_PROMPTS = "prompts as (select doc_id as pos, case when doc_id % 20 = 0 then 'A user asking about ' || text else text end as prompt from documents)"
_META = " or ".join(f"contains(lower(prompt), '{m}')" for m in p.META_PHRASES)
_PER = "per as (select sample_idx, count(*) as total, count(*) filter (where is_valid) as valid, avg(contrast_quality) filter (where is_valid) as quality from pair_scores group by 1)"

ORACLE = {
    "b1_valid_pairs": sql("select pair_id, contrast_quality from pair_scores where is_valid", "pair_scores"),
    "b2_gate_pairs": sql("select pair_id, " + _GATE.format(m="pair_id % 2 <> 0", b="pair_id % 3 <> 0") + " as gate from pair_scores", "pair_scores"),
    "b4_signal_gate": sql("select pair_id, behavioral_signal >= 6 and confound >= 5 as signal_valid, behavioral_signal as contrast_quality from pair_scores", "pair_scores"),
    "b5_length_ratio": sql(
        f"w as (select pair_id, {_WORDS.format(x='dst')} as dst_words, {_WORDS.format(x='src')} as src_words from pairs) select *, round(dst_words / greatest(src_words, 1), 6) as ratio, dst_words / greatest(src_words, 1) between 0.8 and 1.2 as ratio_ideal from w", "pairs"
    ),
    "b6_merge_validations": sql(f"select pair_id, is_valid and structural > 3 as is_valid, round(greatest(contrast_quality, semantic), 6) as contrast_quality, {_MERGED}, case when pair_id % 2 = 0 then 'a | b' else 'b' end as reasoning from pair_scores", "pair_scores"),
    "b7_validate_chain": sql(
        """sem as (select pair_id, list_inner_product(dst_vec, dst_vec) as q, 1 - list_inner_product(dst_vec, src_vec) / (sqrt(list_inner_product(dst_vec, dst_vec)) * sqrt(list_inner_product(src_vec, src_vec))) as c from pair_vectors),
        s as (select pair_id, case when q > 0 then least(10, c / 0.7 * 10) else 0 end as score, q > 0 and c >= 0.9 as ok from sem), j as (select *, """
        + _GATE.format(m="false", b="false")
        + """ as gate from s join pair_scores using (pair_id))
        select pair_id, ok and gate as is_valid, round(case when ok then greatest(score, dimension) else score end, 6) as contrast_quality, case when not ok then 'embedding' when not gate then 'judge' end as failed_stage from j""",
        "pair_vectors",
        "pair_scores",
    ),
    "b8_score_extremes": sql(
        f"""l as ({_LONG}), k as (select * from l where v >= 0)
        select pair_id, coalesce(string_agg(name, ',' order by o), '') as evaluated, coalesce(first(name order by v, o), 'unknown') as weakest, coalesce(first(name order by v desc, o), 'unknown') as strongest from k group by 1""",
        "pair_scores",
    ),
    "b9_improvement_guidance": sql(
        """select pair_id, coalesce(nullif(concat_ws(' | ', case when dimension >= 0 and dimension < 7 and pair_id % 3 = 0 then 'Dimension: flat' end, case when marker >= 0 and marker < 7 and pair_id % 2 = 0 then 'Missing markers: m1, m2, m3' end,
        case when boundary >= 0 and boundary < 7 and pair_id % 4 = 0 then 'Confused with: irony' end, case when semantic >= 0 and semantic < 5 then printf('Responses too similar (semantic score: %.1f)', semantic) end), ''), 'General quality issues') as guidance from pair_scores""",
        "pair_scores",
    ),
    "b10_filter_by_intensity": sql("select pair_id, intensity from pairs where intensity in ('extreme', 'high')", "pairs"),
    "b11_filter_by_confound": sql("select pair_id, confound from pair_scores where case when confound >= 0 then confound else 10 end >= 5", "pair_scores"),
    "b12_filter_by_signal": sql(f"select pair_id, sample_idx from pair_scores qualify row_number() over (partition by sample_idx order by {_SIGNAL} desc, pair_id) <= 5", "pair_scores"),
    "b13_select_maximum_signal": sql(f"select pair_id, sample_idx from pair_scores where intensity = 'extreme' and case when confound >= 0 then confound else 10 end >= 5 and {_SIGNAL} >= 7", "pair_scores"),
    "b13_select_high_signal": sql(f"select pair_id, sample_idx from pair_scores where intensity in ('extreme', 'high') qualify row_number() over (partition by sample_idx order by {_SIGNAL} desc, pair_id) <= 5", "pair_scores"),
    "b13_select_balanced": sql("select pair_id, sample_idx from pair_scores", "pair_scores"),
    "b14_diversity_flags": sql("f as (select sample_idx, count(distinct scenario[:50]) as scenarios, count(distinct coalesce(intensity, 'medium')) as intensities from pairs group by 1) select *, scenarios >= 3 as scenarios_ok, intensities >= 2 as intensities_ok from f", "pairs"),
    "b15_drop_description_prompts": sql(f"prompts2 as (select 1), {_PROMPTS} select pos from prompts where not ({_META})", "seeds"),
    "b18_filter_samples": sql("select sample_idx from candidate_vectors where layer_strategy = 'middle' and contains('s' || sample_idx, '1')", "candidate_vectors"),
    "c6_sample_datasets": sql(
        f"{_ASSIGN} select distinct a.sample_idx, pair_id, 'core' as pool from pairs p join assignments a using (scenario, context) where p.sample_idx = -1 union all select sample_idx, pair_id, 'unique' from pairs where sample_idx >= 0", "pairs", "seeds"
    ),
    "c13_boundary_feedback": sql(
        "n as (select lower(source) as name, min_by('ex' || doc_id, doc_id) as negative_example from documents group by 1) select pair_id, upper(scenario) as confused_with, negative_example from pairs left join n on n.name = lower(scenario)", "pairs"
    ),
    "d7_pool_statistics": sql(
        f"""{_PER} select coalesce(sum(total) filter (where sample_idx = -1), 0) as core_total, coalesce(sum(valid) filter (where sample_idx = -1), 0) as core_valid, round(coalesce(max(quality) filter (where sample_idx = -1), 0), 6) as core_quality,
        coalesce(sum(total) filter (where sample_idx >= 0), 0) as unique_total, coalesce(sum(valid) filter (where sample_idx >= 0), 0) as unique_valid, count(*) filter (where sample_idx >= 0) as samples,
        round(avg(total) filter (where sample_idx >= 0), 6) as avg_pairs, round(avg(quality) filter (where sample_idx >= 0), 6) as avg_quality from per""",
        "pair_scores",
    ),
    "d8_pipeline_totals": sql(f"{_PER} select count(*) as samples, sum(total) as total, sum(valid) as valid, round(avg(coalesce(quality, 0)), 6) as avg_quality from per", "pair_scores"),
    "d9_seed_summary": sql("select count(*) as total, least(80, count(*)) as core, round(avg(quality_score), 6) as avg_quality from seeds", "seeds"),
    "d10_component_coverage": sql(
        f"""{_ASSIGN}, alls as (select count(distinct c) as n from (select unnest(target_components) as c from seeds)), own as (select sample_idx, unnest(target_components) as c from assignments)
        select a.sample_idx, count(distinct c) as covered, round(count(distinct c) / any_value(n), 6) as coverage from (select distinct sample_idx from assignments) a left join own using (sample_idx), alls group by 1""",
        "seeds",
    ),
    "e2_top_pairs": sql("select sample_idx, pair_id, contrast_quality from pair_scores where is_valid qualify row_number() over (partition by sample_idx order by contrast_quality desc, pair_id) <= 3", "pair_scores"),
    "e6_dedup_prompts": sql(f"{_PROMPTS} select pos from prompts qualify row_number() over (partition by lower(trim(prompt, e' \\t\\n\\r')) order by pos) = 1", "seeds"),
    "f1_all_pairs": sql("select case when sample_idx = -1 then 'core' else 'unique' end as pool, count(*) as n, sum(pair_id) as ids from pairs group by 1", "pairs"),
    "f2_distinct_seeds": sql("select scenario, context, min(pos) as pos from seeds group by all", "seeds"),
    "f3_new_sessions": sql("select context from seeds except select context from seeds where pos % 7 = 0", "seeds"),
    "f4_split_seeds": sql("select pos, row_number() over (order by pos) <= 80 as is_core from seeds", "seeds"),
    "g16_pair_to_datapoint": sql("select pair_id, prompt, md5(dst) as dst, 1 as n from pair_scores where is_valid", "pair_scores"),
}
