"""Vectors, task results and datapoints as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.sources.scratch import folder_of

FINAL_REF = "vectors/final.pt"


def vector_refs(df: DataFrame) -> DataFrame:
    """df(session_id, layer, sequence, ..) with version (1, 2, .. per session and layer) and vector_ref; is_final rows have one fixed ref."""
    w = Window.partitionBy("session_id", "layer").orderBy("sequence")
    out = df.withColumn("version", F.row_number().over(w))
    ref = F.format_string("vectors/layer_%02d_v%03d.pt", F.col("layer").cast("int"), F.col("version"))
    return out.withColumn("vector_ref", F.when(F.col("is_final"), F.lit(FINAL_REF)).otherwise(ref) if "is_final" in df.columns else ref)


def save_vectors(df: DataFrame, path: str, folders: int | None = None) -> None:
    """A folder for each session, or sessions dealt to a number of folders."""
    rows = vector_refs(df).withColumn("vector", F.col("vector").cast("array<float>"))
    if folders is None:
        rows.repartition("session_id").write.mode("append").partitionBy("session_id").parquet(path)
    else:
        rows.withColumn("folder", folder_of("session_id", folders)).repartition("folder", "layer").write.mode("append").partitionBy("folder").parquet(path)


def load_vectors(spark: SparkSession, path: str, vector_ref: str | None = None) -> DataFrame:
    out = spark.read.parquet(path).drop("folder")
    return out if vector_ref is None else out.where(F.col("vector_ref") == vector_ref)


def save_task_result(path: str, tables: dict[str, DataFrame]) -> None:
    """Tables of a task (task, behavior, pairs, samples, losses, ..) in a folder each, partitioned by task_id."""
    for name, df in tables.items():
        df.write.mode("append").partitionBy("task_id").parquet(f"{path}/{name}")


def load_task_result(spark: SparkSession, path: str, names: list[str], task_id: int | str | None = None) -> dict[str, DataFrame]:
    """The tables; samples without a result (score) are left out."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        df = df if task_id is None else df.where(F.col("task_id") == task_id)
        out[name] = df.where("score is not null") if name == "samples" else df
    return out


DATAPOINT = "struct<prompt:string,dst_completions:array<string>,src_completions:array<string>,metadata:string>"


def datapoints_to_json(df: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """pair_id, json of df(pair_id, prompt, dst, src, ..); metadata: columns that go along as one JSON text."""
    extra = F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")
    return df.select("pair_id", F.to_json(F.struct("prompt", F.array("dst").alias("dst_completions"), F.array("src").alias("src_completions"), extra.alias("metadata"))).alias("json"))


def datapoints_from_json(df: DataFrame) -> DataFrame:
    return df.select("pair_id", F.from_json("json", DATAPOINT).alias("d")).select("pair_id", "d.*")


def serialize_sample_datasets(pairs: DataFrame, scores: list[str]) -> DataFrame:
    """sample_idx, pair_id, json: one row per valid pair with its evaluated scores and the weakest."""
    from contrail.operators.pairs import score_extremes

    body = F.struct("pair_id", "weakest", *(F.when(F.col(s) >= 0, F.col(s)).alias(s) for s in scores))
    return score_extremes(pairs, scores).where(F.coalesce("is_valid", F.lit(False))).select("sample_idx", "pair_id", F.to_json(body).alias("json"))


def sample_dataset_summary(pairs: DataFrame) -> DataFrame:
    """sample_idx, total, valid, avg_quality (of the valid; none: 0)."""
    ok = F.coalesce("is_valid", F.lit(False))
    out = pairs.groupBy("sample_idx").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.avg(F.when(ok, F.coalesce("contrast_quality", F.lit(0.0)))).alias("avg_quality"))
    return out.withColumn("avg_quality", F.coalesce("avg_quality", F.lit(0.0)))


def task_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per task of loaded tables task, behavior, pairs, samples and losses: task_id, behavior, status, samples, best_score, pairs,
    valid_pairs, losses, last_loss (the mean of the samples' last losses)."""
    samples = tables["samples"].groupBy("task_id").agg(F.count("*").alias("samples"), F.max("score").alias("best_score"))
    pairs = tables["pairs"].groupBy("task_id").agg(F.count("*").alias("pairs"), F.count_if("is_valid").alias("valid_pairs"))
    last = tables["losses"].groupBy("task_id", "sample_idx").agg(F.count("*").alias("n"), F.max_by("loss", "step").alias("last"))
    losses = last.groupBy("task_id").agg(F.sum("n").alias("losses"), F.avg("last").alias("last_loss"))
    out = tables["task"].select("task_id", "status").join(tables["behavior"].select("task_id", F.col("name").alias("behavior")), "task_id", "left")
    for part in (samples, pairs, losses):
        out = out.join(part, "task_id", "left")
    return out.na.fill(0, ["samples", "pairs", "valid_pairs", "losses"])
