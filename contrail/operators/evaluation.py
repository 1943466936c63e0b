"""Judgements to scores: calibration by strength, dimensions, overall, and the tournament over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.pairs import with_position
from contrail.sources.scratch import kept

#: Default weights of the dimensions.
WEIGHTS = {"behavior": 0.30, "specificity": 0.25, "coherence": 0.20, "capability": 0.15, "generalization": 0.10}
#: Fixed values of evaluation depths: share of the budget, active dimensions with weights.
DEPTHS = {
    "quick": (0.10, {"behavior": 1.0}),
    "medium": (0.40, {"behavior": 0.5, "specificity": 0.3, "coherence": 0.2}),
    "full": (1.0, WEIGHTS),
}


def behavior_calibration(judgements: DataFrame) -> DataFrame:
    """sample_idx, strength, score: mean score per strength."""
    return judgements.groupBy("sample_idx", "strength").agg(F.avg("score").alias("score"))


def main_score(calibration: DataFrame) -> DataFrame:
    """sample_idx, behavior: the score at strength 1.0, else the mean over strengths."""
    at_one = F.max(F.when(F.col("strength") == 1.0, F.col("score")))
    return calibration.groupBy("sample_idx").agg(F.coalesce(at_one, F.avg("score")).alias("behavior"))


def dimension_scores(judgements: DataFrame) -> DataFrame:
    """sample_idx, dimension, score: means."""
    return judgements.groupBy("sample_idx", "dimension").agg(F.avg("score").alias("score"))


def optimal_strength(calibration: DataFrame, penalty: float = 0.1) -> DataFrame:
    """sample_idx, strength with the largest score - penalty * |strength - 1| over 0, the lowest on ties; none: 1.0."""
    adjusted = F.round(F.col("score") - penalty * F.abs(F.col("strength") - 1), 9)
    rows = calibration.select("sample_idx", "strength", F.when(adjusted > 0, adjusted).alias("a"))
    best = F.max_by("strength", F.when(F.col("a").isNotNull(), F.struct("a", (-F.col("strength")).alias("s"))))
    return rows.groupBy("sample_idx").agg(F.coalesce(best, F.lit(1.0)).alias("best_strength"))


def overall_score(scores: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """sample_idx, overall: sum of score / 10 * weight over dimensions; a missing dimension adds 0."""
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("dimension")), F.lit(0.0))
    return scores.groupBy("sample_idx").agg(F.sum(F.col("score") / 10 * weight).alias("overall"))


def answer_preservation(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by columns, baseline_correct, steered_correct, score of rows(expected, baseline, steered): correct holds the expected text, case
    apart; score is ten times steered / baseline; with baseline 0: 10 if any steered is correct, else 5."""
    has = lambda c: F.coalesce(F.lower(c).contains(F.lower("expected")), F.lit(False)).cast("long")
    out = rows.groupBy(*by).agg(F.sum(has("baseline")).alias("baseline_correct"), F.sum(has("steered")).alias("steered_correct"))
    ratio = F.when(F.col("baseline_correct") > 0, F.col("steered_correct") / F.col("baseline_correct")).when(F.col("steered_correct") > 0, 1.0).otherwise(0.5)
    return out.withColumn("score", ratio * 10)


def tournament_plan(spark: SparkSession, rounds: int, survivors: int, rate: float, min_datapoints: int = 10, max_datapoints: int = 80, prompts: int = 50, strengths: Sequence[float] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """One row per round and a last one for the final: round, rows, survivors, datapoints, depth, prompts, strengths, dimensions, cost.

    Rows of round i are int(initial * (1 - rate)^i), initial is int(survivors / (1 - rate)^rounds). The first rounds are quick, the one
    before the final medium if there are several, the final full.
    """
    keep = 1 - rate
    initial = int(survivors / keep**rounds)
    out = []
    for i in range(rounds + 1):
        depth = "full" if i == rounds else "medium" if i and i == rounds - 1 else "quick"
        budget, dims = DEPTHS[depth]
        n = int(initial * keep**i)
        count = max(2, round(len(strengths) * budget))
        step = (len(strengths) - 1) / (count - 1)
        levels = {strengths[round(j * step)] for j in range(count)}
        if 1.0 in strengths and 1.0 not in levels:
            levels = (levels - {max(levels - {min(levels)})}) | {1.0}
        asked = max(5, int(prompts * budget))
        out.append((i, n, int(initial * keep ** (i + 1)) if i < rounds else n, min_datapoints + (max_datapoints - min_datapoints) * i // max(rounds, 1), depth, asked, sorted(levels), dims, float(asked * len(levels) * len(dims))))
    schema = "round int, rows int, survivors int, datapoints int, depth string, prompts int, strengths array<double>, weights map<string,double>, cost double"
    return spark.createDataFrame(out, schema)


def plan_for(available: DataFrame, plan: DataFrame) -> DataFrame:
    """The rounds of a plan for each row of available(.., available): entrants (no more than there are or than survived), survivors and the
    round's cost for all entrants."""
    rounds = available.crossJoin(F.broadcast(plan))  # a row per round
    entrants, left = F.least("rows", "available"), F.least("survivors", "available")
    return rounds.select(*available.columns, "round", "depth", entrants.alias("entrants"), left.alias("survivors"), (entrants * F.col("cost")).alias("cost"))


def run_tournament(scores: DataFrame, plan: Sequence[tuple[int, int]]) -> DataFrame:
    """round, sample_idx, score, rank, survived of scores(round, sample_idx, pos, score, is_valid); plan: (round, survivors).

    Every round ranks all active rows by ranges, invalid ones with score 0, earlier pos first on ties; the last round cuts nothing. Rounds
    are written one after the other when this is called, so that none is computed again by the next.
    """
    active, out = None, None
    for i, (number, keep) in enumerate(plan):
        rows = scores.where(F.col("round") == number).withColumn("score", F.when(F.col("is_valid"), F.col("score")).otherwise(0.0))
        if active is not None:
            rows = rows.join(active, "sample_idx", "left_semi")
        last = i == len(plan) - 1
        order = F.struct(F.col("score").isNull().alias("none"), (~F.isnan("score")).alias("number"), (-F.col("score")).alias("down"), "pos")
        ranked = with_position(rows.withColumn("_o", order), "_o").withColumn("rank", (F.col("position") + 1).cast("int")).withColumn("survived", F.lit(True) if last else F.col("rank") <= keep)
        ranked = kept(ranked.select("round", "sample_idx", "score", "rank", "survived"))
        out = ranked if out is None else out.unionByName(ranked)
        active = ranked.where("survived").select("sample_idx")
    return out


def evaluate_round(judgements: DataFrame, depth: str) -> DataFrame:
    """sample_idx, overall with the active dimensions and weights of a depth."""
    weights = DEPTHS[depth][1]
    return overall_score(dimension_scores(judgements.where(F.col("dimension").isin(list(weights)))), weights)


def inference_savings(rounds: DataFrame, full_cost: float) -> DataFrame:
    """One row: savings = 1 - sum(rows * cost) / (rows of the first round * full cost); no full cost: 0."""
    out = rounds.agg(F.sum(F.col("rows") * F.col("cost")).alias("used"), F.max_by("rows", -F.col("round")).alias("initial"))
    flat = F.col("initial") * full_cost
    return out.select(F.when(flat > 0, 1 - F.col("used") / flat).otherwise(0.0).alias("savings"))


#: What an estimate needs to know of a task's configuration.
ESTIMATE = (
    "max_iters", "datapoints_per_sample", "behavior_prompts", "n_strengths", "behavior_generations", "specificity_prompts", "coherence_prompts", "capability_prompts", "generalization_prompts",
)


def inference_estimate(config: DataFrame) -> DataFrame:
    """task_id, per_sample of config(task_id, the columns of ESTIMATE): calls of one sample, both sides of each datapoint in every iteration, then its evaluation
    (behaviour and coherence at every strength, the others with and without steering). A null counts as 0."""
    c = {k: F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in ESTIMATE}
    extraction = c["max_iters"] * c["datapoints_per_sample"] * 2
    by_strength = (c["behavior_prompts"] * c["behavior_generations"] + c["coherence_prompts"]) * c["n_strengths"]
    twice = 2 * (c["specificity_prompts"] + c["capability_prompts"] + c["generalization_prompts"])
    return config.select("task_id", (extraction + by_strength + twice).alias("per_sample"))


def task_rollup(samples: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """task_id, n, valid, best_sample, best_score, duration of samples(task_id, sample_idx, pos, score, is_valid, started, completed); with a
    config (see inference_estimate) also inferences, the task's samples times their calls (unknown task: null)."""
    best = F.max_by("sample_idx", F.when(F.col("is_valid"), F.struct("score", (-F.col("pos")).alias("p"))))
    out = samples.groupBy("task_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_valid").alias("valid"),
        best.alias("best_sample"),
        F.max(F.when(F.col("is_valid"), F.col("score"))).alias("best_score"),
        F.greatest(F.coalesce(F.max("completed") - F.min("started"), F.lit(0)), F.lit(0)).alias("duration"),
    )
    if config is None:
        return out
    return out.join(inference_estimate(config), "task_id", "left").withColumn("inferences", F.col("n") * F.col("per_sample")).drop("per_sample")
