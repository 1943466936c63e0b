"""Datapoint quality: training metrics, influence, scores and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.vectors import total


def training_metrics_summary(df: DataFrame) -> DataFrame:
    """datapoint_id, avg_loss (empty: 0), loss_variance (population; up to one value: 0) of loss_history arrays."""
    n = F.size("loss_history")
    mean = F.when(n > 0, total(F.col("loss_history")) / n).otherwise(0.0)
    rows = df.select("*", mean.alias("avg_loss"))
    spread = total(F.transform("loss_history", lambda x: (x - F.col("avg_loss")) * (x - F.col("avg_loss")))) / n
    return rows.withColumn("loss_variance", F.when(n > 1, spread).otherwise(0.0))


def alignment_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """by columns, avg_alignment; no value: 0."""
    return df.groupBy(*by).agg(F.coalesce(F.avg("alignment"), F.lit(0.0)).alias("avg_alignment"))


def attach_training_metrics(datapoints: DataFrame, metrics: DataFrame) -> DataFrame:
    """Join by position; rows beyond the shorter table go."""
    return datapoints.join(metrics, "position")


def loo_influence(datapoints: DataFrame, scores_without: DataFrame, full_score: float) -> DataFrame:
    """datapoints with influence = score without the datapoint - full score; not measured: 0."""
    return datapoints.join(scores_without, "datapoint_id", "left").withColumn("influence", F.coalesce(F.col("score_without") - full_score, F.lit(0.0))).drop("score_without")


def quality_score(df: DataFrame) -> DataFrame:
    """df(influence, alignment, steered_matches, is_outlier) with quality_score and recommendation (KEEP over 0.7, REVIEW over 0.4)."""
    harm = F.when(F.col("influence") > 0, F.least(F.lit(0.5), F.col("influence"))).otherwise(0.0)
    score = 1 - harm + F.when(F.col("alignment") < 0, 0.3 * F.col("alignment")).otherwise(0.0)
    score = score - F.when(F.coalesce("steered_matches", F.lit(True)), 0.0).otherwise(0.3) - F.when(F.coalesce("is_outlier", F.lit(False)), 0.2).otherwise(0.0)
    out = df.withColumn("quality_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return out.withColumn("recommendation", F.when(F.col("quality_score") > 0.7, "KEEP").when(F.col("quality_score") > 0.4, "REVIEW").otherwise("REMOVE"))


KINDS = ("KEEP", "REVIEW", "REMOVE")


def recommendation_rollup(df: DataFrame) -> DataFrame:
    """recommendation, n for each of the three recommendations, empty ones too; their rows: recommendation_members."""
    kinds = df.sparkSession.createDataFrame([(k,) for k in KINDS], "recommendation string")
    found = df.groupBy("recommendation").agg(F.count("*").alias("n"))
    return kinds.join(found, "recommendation", "left").select("recommendation", F.coalesce("n", F.lit(0)).alias("n"))


def recommendation_members(df: DataFrame) -> DataFrame:
    """recommendation, datapoint_id: one row per datapoint of the three recommendations."""
    return df.where(F.col("recommendation").isin(*KINDS)).select("recommendation", "datapoint_id")


def problematic_datapoints(df: DataFrame) -> DataFrame:
    return df.where(F.col("recommendation").isin("REMOVE", "REVIEW"))
