"""Queries on quality, sampling, judgements and tournaments."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.fixtures import candidate_vectors, judgements, pair_scores, quality_rows, read, seeds, sql, training_metrics
from contrail.operators import evaluation as e
from contrail.operators import quality as q
from contrail.operators import sampling as m
from contrail.queries.vectors import rounded

SHARES = {"extreme": 0.1, "high": 0.2, "medium": 0.3, "natural": 0.4}


def _metrics(s, d):
    return rounded(q.training_metrics_summary(training_metrics(s, d)).select("datapoint_id", "avg_loss", "loss_variance"), "avg_loss", "loss_variance")


def _scored(s, d):
    return rounded(q.quality_score(quality_rows(s, d)).select("datapoint_id", "quality_score", "recommendation"), "quality_score")


def _rollup(s, d):
    scored = q.quality_score(quality_rows(s, d))
    ids = q.recommendation_members(scored).groupBy("recommendation").agg(F.sum("datapoint_id").alias("ids"))
    return q.recommendation_rollup(scored).join(ids, "recommendation", "left").na.fill(0, ["ids"])


def _influence(s, d):
    rows = read(s, d, "labels").select(F.col("doc_id").alias("datapoint_id"))
    without = rows.where("datapoint_id % 3 <> 0").withColumn("score_without", (F.col("datapoint_id") * 7 % 101) / 100.0)
    return rounded(q.loo_influence(rows, without, 0.5), "influence")


def _attach(s, d):
    left = read(s, d, "documents").selectExpr("doc_id as position", "lang")
    right = training_metrics(s, d).selectExpr("datapoint_id as position", "size(loss_history) as n")
    return q.attach_training_metrics(left, right)


def _capability(s, d):
    rows = read(s, d, "documents").selectExpr("doc_id % 16 as grp", "lang as expected", "if(doc_id % 3 <> 0, upper(lang), 'xx') as baseline", "if(doc_id % 4 <> 0, lang, 'xx') as steered")
    return rounded(e.answer_preservation(rows, ["grp"]), "score")


def _tournament_scores(s, d):
    rows = candidate_vectors(s, d).select("sample_idx", "pos", "is_valid", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("round"))
    return rows.withColumn("score", F.when(F.col("is_valid"), (F.col("sample_idx") * (7 + 4 * F.col("round"))) % 101 / 100.0).otherwise(0.0))


def _overall(s, d):
    return rounded(e.overall_score(e.dimension_scores(judgements(s, d))), "overall")


def _savings(s, d):
    n = candidate_vectors(s, d).where("is_valid").selectExpr("pos % 3 as round", "1 as one").groupBy("round").agg(F.sum("one").alias("rows"))
    return rounded(e.inference_savings(n.withColumn("cost", F.col("round") * 2.0 + 1), 10.0), "savings")


def _tasks(s, d):
    rows = candidate_vectors(s, d).selectExpr("pos % 9 as task_id", "sample_idx", "pos", "overall_score as score", "is_valid", "pos * 3 as started", "if(pos % 2 = 0, pos * 3 + pos % 11, null) as completed")
    config = candidate_vectors(s, d).selectExpr("pos % 9 as task_id").groupBy("task_id").agg(F.count("*").alias("max_iters"))
    sizes = {c: F.col("task_id") + i for i, c in enumerate(e.ESTIMATE) if i}
    return e.task_rollup(rows, config.withColumns(sizes))


def _coverage(s, d):
    """What a covered territory promises: each sample has its seeds once, and one for every component."""
    picked = m.assign_territory(seeds(s, d), 12, 20).join(seeds(s, d).select("pos", F.explode(F.when(F.size("target_components") > 0, F.col("target_components")).otherwise(F.array(F.lit("_general")))).alias("c")), "pos")
    return picked.groupBy("sample_idx").agg(F.countDistinct("slot").alias("seeds"), F.countDistinct("pos").alias("different"), F.countDistinct("c").alias("components"))


def _plan(s, d):
    n = read(s, d, "embeddings").agg(F.count("*").alias("available"))
    plan = e.tournament_plan(s, 2, 16, 0.75).select("round", "rows", "survivors", "datapoints", "depth", F.size("strengths").alias("strengths"))
    return plan.crossJoin(F.broadcast(n)).withColumn("enough", F.col("available") >= F.col("rows"))


def _plans(s, d):
    """A tournament for each layer strategy, with as many entrants as there are."""
    available = candidate_vectors(s, d).where("is_valid").groupBy("layer_strategy", "label").agg(F.count("*").alias("available"))
    return e.plan_for(available, e.tournament_plan(s, 2, 16, 0.75))


QUERIES = {
    "d5_training_metrics": _metrics,
    "c10_loo_influence": _influence,
    "c11_attach_training_metrics": _attach,
    "e13_quality_score": _scored,
    "d6_recommendation_rollup": _rollup,
    "d6_recommendation_members": lambda s, d: q.recommendation_members(q.quality_score(quality_rows(s, d))),
    "b17_problematic_datapoints": lambda s, d: q.problematic_datapoints(q.quality_score(quality_rows(s, d))).select("datapoint_id"),
    "e10_assign_intensity": lambda s, d: m.assign_intensity(seeds(s, d), SHARES).select("pos", "intensity"),
    "e11_subsample": lambda s, d: m.subsample(pair_scores(s, d).withColumnRenamed("pair_id", "pos"), 0.3, 5, 20, ["sample_idx"]).select("sample_idx", "pos"),
    "e11_subsample_whole": lambda s, d: m.subsample(pair_scores(s, d).withColumnRenamed("pair_id", "pos"), 0.3, 5).select("pos"),
    "e8_assign_territory": lambda s, d: m.assign_territory(seeds(s, d), 12, 20, ensure_coverage=False, randomize=False),
    "e8_assign_territory_covered": lambda s, d: m.assign_territory(seeds(s, d), 12, 20),
    "e8_territory_coverage": _coverage,
    "e9_balance_attributes": lambda s, d: m.assign_territory(seeds(s, d), 12, 20, balance=("formality", "domain")),
    "d11_behavior_calibration": lambda s, d: rounded(e.behavior_calibration(judgements(s, d)), "score"),
    "d11_main_score": lambda s, d: rounded(e.main_score(e.behavior_calibration(judgements(s, d))), "behavior"),
    "d12_dimension_scores": lambda s, d: rounded(e.dimension_scores(judgements(s, d)), "score"),
    "d13_overall_score": _overall,
    "d14_optimal_strength": lambda s, d: e.optimal_strength(e.behavior_calibration(judgements(s, d))),
    "c9_answer_preservation": _capability,
    "e3_tournament_plan": _plan,
    "e3_tournament_by_group": _plans,
    "e4_run_tournament": lambda s, d: e.run_tournament(_tournament_scores(s, d), [(0, 200), (1, 40), (2, 40)]),
    "e4_run_tournament_all": lambda s, d: e.run_tournament(_tournament_scores(s, d), [(0, 64), (1, 16), (2, 16)]),
    "e5_evaluate_round": lambda s, d: rounded(e.evaluate_round(judgements(s, d), "medium"), "overall"),
    "d31_inference_savings": _savings,
    "d34_task_rollup": _tasks,
}

_QUALITY = """q as (select datapoint_id, greatest(0, least(1, 1 - case when influence > 0 then least(0.5, influence) else 0 end + case when alignment < 0 then 0.3 * alignment else 0 end
  - case when steered_matches then 0 else 0.3 end - case when is_outlier then 0.2 else 0 end)) as s from quality_rows),
r as (select datapoint_id, s, case when s > 0.7 then 'KEEP' when s > 0.4 then 'REVIEW' else 'REMOVE' end as rec from q)"""
_DIMS = "dims as (select sample_idx, dimension, avg(score) as s from judgements group by all)"
_CAL = "cal as (select sample_idx, strength, avg(score) as s from judgements group by all)"
_T = "t as (select sample_idx, pos, is_valid, r, case when is_valid then (sample_idx * (7 + 4 * r)) % 101 / 100.0 else 0 end as score from candidate_vectors, range(0, 3) x(r))"

ORACLE = {
    "d5_training_metrics": sql("select datapoint_id, round(coalesce(list_avg(loss_history), 0), 6) as avg_loss, round(case when len(loss_history) > 1 then list_var_pop(loss_history) else 0 end, 6) as loss_variance from training_metrics", "training_metrics"),
    "c10_loo_influence": "select doc_id as datapoint_id, round(case when doc_id % 3 <> 0 then (doc_id * 7 % 101) / 100.0 - 0.5 else 0 end, 6) as influence from labels",
    "c11_attach_training_metrics": "select doc_id as position, lang, doc_id % 5 as n from documents join labels using (doc_id)",
    "e13_quality_score": sql(f"{_QUALITY} select datapoint_id, round(s, 6) as quality_score, rec as recommendation from r", "quality_rows"),
    "d6_recommendation_rollup": sql(f"{_QUALITY} select k as recommendation, count(datapoint_id) as n, coalesce(sum(datapoint_id), 0) as ids from (values ('KEEP'), ('REVIEW'), ('REMOVE')) v(k) left join r on rec = k group by 1", "quality_rows"),
    "d6_recommendation_members": sql(f"{_QUALITY} select rec as recommendation, datapoint_id from r", "quality_rows"),
    "b17_problematic_datapoints": sql(f"{_QUALITY} select datapoint_id from r where rec <> 'KEEP'", "quality_rows"),
    "e10_assign_intensity": sql(
        "n as (select count(*) as n from seeds), p as (select pos, row_number() over (order by pos) - 1 as i, n from seeds, n) select pos, case when i < floor(n * 0.1) then 'extreme' when i < floor(n * 0.1) + floor(n * 0.2) then 'high' when i < floor(n * 0.1) + floor(n * 0.2) + floor(n * 0.3) then 'medium' else 'natural' end as intensity from p",
        "seeds",
    ),
    "e11_subsample": sql(
        "r as (select sample_idx, pair_id as pos, row_number() over (partition by sample_idx order by ((5 * 7919 + pair_id % 1000003) * 104729 + 13) % 1000003, pair_id) as r, count(*) over (partition by sample_idx) as n from pair_scores) select sample_idx, pos from r where r <= least(20, greatest(1, floor(n * 0.3)))", "pair_scores"
    ),
    "e11_subsample_whole": sql("select pair_id as pos from pair_scores qualify row_number() over (order by ((5 * 7919 + pair_id % 1000003) * 104729 + 13) % 1000003, pair_id) <= greatest(1, floor(count(*) over () * 0.3))", "pair_scores"),
    "e8_assign_territory": sql(
        "o as (select pos, row_number() over (order by quality_score desc, pos) - 1 as i, count(*) over () as n from seeds), a as (select sample_idx, slot, (sample_idx * n // 12 + slot) % n as at from (select distinct n from o), range(0, 12) x(sample_idx), range(0, 20) y(slot)) select sample_idx, slot, pos from a join o on o.i = a.at", "seeds"
    ),
    "e8_territory_coverage": sql(
        """c as (select distinct unnest(case when len(target_components) > 0 then target_components else ['_general'] end) as c from seeds), n as (select least(20, count(*)) as n from seeds)
        select sample_idx, n as seeds, n as different, (select count(*) from c) as components from n, range(0, 12) x(sample_idx)""",
        "seeds",
    ),
    "d11_behavior_calibration": sql(f"{_CAL} select sample_idx, strength, round(s, 6) as score from cal", "judgements"),
    "d11_main_score": sql(f"{_CAL} select sample_idx, round(coalesce(max(s) filter (where strength = 1), avg(s)), 6) as behavior from cal group by 1", "judgements"),
    "d12_dimension_scores": sql(f"{_DIMS} select sample_idx, dimension, round(s, 6) as score from dims", "judgements"),
    "d13_overall_score": sql(f"{_DIMS} select sample_idx, round(sum(s / 10 * case dimension when 'behavior' then 0.3 when 'specificity' then 0.25 when 'coherence' then 0.2 when 'generalization' then 0.1 else 0 end), 6) as overall from dims group by 1", "judgements"),
    "d14_optimal_strength": sql(f"{_CAL}, a as (select sample_idx, strength, round(s - 0.1 * abs(strength - 1), 9) as v from cal) select sample_idx, coalesce(first(strength order by v desc, strength) filter (where v > 0), 1.0) as best_strength from a group by 1", "judgements"),
    "c9_answer_preservation": """with r as (select doc_id % 16 as grp, count(*) filter (where doc_id % 3 <> 0) as b, count(*) filter (where doc_id % 4 <> 0) as s from documents group by 1)
        select grp, b as baseline_correct, s as steered_correct, round(10 * case when b > 0 then s / b when s > 0 then 1 else 0.5 end, 6) as score from r""",
    "e3_tournament_plan": """select i as round, n as rows, k as survivors, p as datapoints, d as depth, c as strengths, (select count(*) from embeddings) as available, (select count(*) from embeddings) >= n as enough
        from (values (0, 256, 64, 10, 'quick', 2), (1, 64, 16, 45, 'medium', 2), (2, 16, 16, 80, 'full', 4)) v(i, n, k, p, d, c)""",
    "e4_run_tournament_all": sql(
        f"""{_T}, a as (select *, row_number() over (order by score desc, pos) as rank from t where r = 0), b as (select *, row_number() over (order by score desc, pos) as rank from t where r = 1 and sample_idx in (select sample_idx from a where rank <= 64)),
        c as (select *, row_number() over (order by score desc, pos) as rank from t where r = 2 and sample_idx in (select sample_idx from b where rank <= 16))
        select r as round, sample_idx, score, rank, rank <= 64 as survived from a union all select r, sample_idx, score, rank, rank <= 16 from b union all select r, sample_idx, score, rank, true from c""",
        "candidate_vectors",
    ),
    "e3_tournament_by_group": sql(
        """a as (select layer_strategy, label, count(*) as available from candidate_vectors where is_valid group by all), p as (select * from (values (0, 256, 64, 'quick', 10), (1, 64, 16, 'medium', 120), (2, 16, 16, 'full', 1000)) v(round, rows, survivors, depth, cost))
        select layer_strategy, label, available, round, depth, least(rows, available) as entrants, least(p.survivors, available) as survivors, least(rows, available) * cost as cost from a, p""",
        "candidate_vectors",
    ),
    "e5_evaluate_round": sql(f"{_DIMS} select sample_idx, round(sum(s / 10 * case dimension when 'behavior' then 0.5 when 'specificity' then 0.3 else 0.2 end), 6) as overall from dims where dimension <> 'generalization' group by 1", "judgements"),
    "d31_inference_savings": sql("r as (select pos % 3 as round, count(*) as n from candidate_vectors where is_valid group by 1) select round(1 - sum(n * (round * 2 + 1)) / (min_by(n, round) * 10.0), 6) as savings from r", "candidate_vectors"),
    "d34_task_rollup": sql(
        """select t as task_id, count(*) as n, count(*) filter (where is_valid) as valid, first(sample_idx order by overall_score desc, pos) filter (where is_valid) as best_sample, max(overall_score) filter (where is_valid) as best_score,
        greatest(0, max(case when pos % 2 = 0 then pos * 3 + pos % 11 end) - min(pos * 3)) as duration,
        count(*) * (count(*) * (t + 1) * 2 + ((t + 2) * (t + 4) + t + 6) * (t + 3) + 2 * (t + 5 + t + 7 + t + 8)) as inferences from (select *, pos % 9 as t from candidate_vectors) group by t""",
        "candidate_vectors",
    ),
}
# the same with more survivors
ORACLE["e4_run_tournament"] = ORACLE["e4_run_tournament_all"].replace("<= 64", "<= 200").replace("<= 16", "<= 40")
