"""Event logs and session metadata as JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.operators.replay import last_rows, numbered
from contrail.sources.scratch import PIECE, folder_of

#: Event categories.
CATEGORIES = ("session", "llm", "tool", "vector", "datapoint", "evaluation", "checkpoint", "state", "contrast", "seed", "optimization")
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)
#: The fields of every kind's payload. Objects of any shape stay JSON text.
PAYLOADS = {
    "session.started": "behavior_name string, behavior_description string, config string",
    "session.completed": "success boolean, final_vector_ref string, final_layer int, final_score double, total_llm_calls long, total_tokens long, duration_seconds double, error string",
    "llm.request": "request_id string, model string, messages array<struct<role:string,content:string>>, tools string, temperature double, max_tokens int, extra_params string",
    "llm.response": "request_id string, content string, tool_calls string, finish_reason string, usage struct<total_tokens:long,estimated_tokens:long>, latency_ms double, error string",
    "llm.chunk": "request_id string, chunk string, chunk_index int, accumulated string",
    "tool.call": "call_id string, tool_name string, arguments string, agent_id string",
    "tool.result": "call_id string, success boolean, output string, error string, latency_ms double",
    "vector.created": "vector_id string, layer int, vector_ref string, shape array<int>, dtype string, norm double, optimization_metrics string",
    "vector.comparison": "vector_ids array<string>, similarities map<string,double>",
    "vector.selected": "vector_id string, layer int, strength double, score double, reason string",
    "datapoint.added": "datapoint_id string, prompt string, positive_completion string, negative_completion string, domain string, format_type string",
    "datapoint.removed": "datapoint_id string, reason string",
    "datapoint.quality": "datapoint_id string, leave_one_out_influence double, gradient_alignment double, avg_loss_contribution double, quality_score double, recommendation string, is_outlier boolean",
    "evaluation.started": "evaluation_id string, eval_type string, vector_id string, layer int, sample_idx int, strength_levels array<double>, num_prompts int, dimensions array<string>",
    "evaluation.dimension_started": "evaluation_id string, dimension string, num_prompts int, num_generations int",
    "evaluation.generation": "evaluation_id string, dimension string, prompt string, output string, strength double, generation_index int, is_baseline boolean",
    "evaluation.judge_call": "evaluation_id string, dimension string, prompt string, num_outputs int, scores array<double>, latency_ms double",
    "evaluation.dimension_completed": "evaluation_id string, dimension string, score double, max_score double, details string, duration_seconds double",
    "evaluation.progress": "evaluation_id string, phase string, completed int, total int, current_dimension string",
    "evaluation.output": "evaluation_id string, prompt string, output string, strength double, is_baseline boolean",
    "evaluation.completed": "evaluation_id string, sample_idx int, scores map<string,double>, dimension_scores map<string,double>, citations string, recommendations array<string>, verdict string, recommended_strength double, raw_judge_output string, duration_seconds double, total_generations long, total_judge_calls long",
    "checkpoint.created": "checkpoint_id string, description string, state_ref string",
    "checkpoint.rollback": "checkpoint_id string, previous_sequence long",
    "state.update": "field string, old_value string, new_value string",
    "state.iteration_started": "iteration_type string, iteration int, max_iterations int",
    "state.iteration_completed": "iteration_type string, iteration int, result string",
    "contrast.behavior_analyzed": "behavior_name string, num_components int, components string, trigger_conditions array<string>, contrast_dimensions array<string>",
    "contrast.pipeline_started": "behavior_description string, num_samples int, config string",
    "contrast.pipeline_completed": "num_samples int, total_pairs_generated long, total_valid_pairs long, avg_quality double, duration_seconds double",
    "contrast.pair_generated": "pair_id string, seed_id string, prompt string, dst_response string, src_response string, sample_idx int",
    "contrast.pair_validated": "pair_id string, is_valid boolean, contrast_quality double, dimension_score double, marker_score double, boundary_score double, intensity_score double, structural_score double, semantic_score double, dst_score double, src_score double, weakest_dimension string, rejection_reason string",
    "seed.generation_started": "num_seeds_requested int, behavior_name string",
    "seed.generated": "seed_id string, scenario string, context string, quality_score double, is_core boolean",
    "seed.generation_completed": "total_generated int, total_filtered int, avg_quality double",
    "seed.assigned": "sample_idx int, num_core_seeds int, num_unique_seeds int, seed_ids array<string>",
    "optimization.started": "sample_idx int, layer int, num_datapoints int, config string",
    "optimization.progress": "sample_idx int, iteration int, loss double, norm double",
    "optimization.completed": "sample_idx int, layer int, final_loss double, iterations int, loss_history array<double>, datapoints_used int, duration_seconds double, success boolean, error string",
    "optimization.aggregation_completed": "strategy string, num_vectors int, top_k int, ensemble_components array<string>, final_score double, final_layer int",
    "optimization.ranking_completed": "rankings string, total_samples int, valid_samples int",
}


def event_category(event_type: Column) -> Column:
    """The part before the first dot; not a category: state."""
    head = F.substring_index(event_type, ".", 1)
    return F.when(head.isin(*CATEGORIES), head).otherwise(F.lit("state"))


def well_formed(df: DataFrame) -> Column:
    needed = [F.col(c).isNotNull() for c in ("session_id", "timestamp", "sequence", "event_type")]
    ok = F.col("_corrupt").isNull() & F.col("category").isin(*CATEGORIES)
    for n in needed:
        ok &= n
    return ok


def _reader(stream) -> object:
    return stream.schema(T.StructType([*ENVELOPE.fields, T.StructField("_corrupt", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")


def select_events(df: DataFrame, event_types: Sequence[str] | None = None, categories: Sequence[str] | None = None, after_sequence: int = 0) -> DataFrame:
    """Empty lists filter nothing."""
    if event_types:
        df = df.where(F.col("event_type").isin(*event_types))
    if categories:
        df = df.where(F.col("category").isin(*categories))
    return df.where(F.col("sequence") > after_sequence) if after_sequence else df


def read_events(spark: SparkSession, path: str, event_types: Sequence[str] | None = None, categories: Sequence[str] | None = None, after_sequence: int = 0) -> DataFrame:
    """Well-formed lines of JSONL logs; blank lines, bad JSON, missing fields and unknown categories are skipped (see read_quarantine)."""
    rows = _reader(spark.read).json(path)
    return select_events(rows.where(well_formed(rows)).drop("_corrupt"), event_types, categories, after_sequence)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """The raw text of lines that read_events skips, blank ones apart."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("e", F.from_json("value", T.StructType([*ENVELOPE.fields, T.StructField("_corrupt", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt"}))
    rows = parsed.select("value", "e.*")
    return rows.where(~F.coalesce(well_formed(rows), F.lit(False))).select(F.col("value").alias("line"))


def stream_event_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same lines as a stream of files that don't change once they are there; each is read once (contrail.sources.live_logs reads files that grow)."""
    reader = _reader(spark.readStream)
    rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(path)
    return rows.where(well_formed(rows)).drop("_corrupt")


def events_of(df: DataFrame, event_type: str) -> DataFrame:
    """session_id, sequence, timestamp, source and the payload's typed fields for one kind of event."""
    body = F.from_json("payload", PAYLOADS[event_type]).alias("p")
    return df.where(F.col("event_type") == event_type).select("session_id", "sequence", "timestamp", "source", body).select("session_id", "sequence", "timestamp", "source", "p.*")


def next_sequences(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new(session_id, pos, ..) with category and sequence: after the largest of its session, in order of pos, a unique whole number. A long session is numbered by many tasks."""
    last = existing.groupBy("session_id").agg(F.max("sequence").alias("_last"))
    out = numbered(new, "session_id", "pos", "_nth").join(last, "session_id", "left").withColumn("sequence", F.coalesce("_last", F.lit(0)) + F.col("_nth"))
    return out.withColumn("category", event_category(F.col("event_type"))).drop("_last", "_nth")


def append_events(new: DataFrame, existing: DataFrame, path: str, folders: int | None = None) -> None:
    """Write new events behind the existing ones, one folder per session or sessions dealt to a number of folders, null fields kept."""
    rows = next_sequences(new, existing).select(*ENVELOPE.fieldNames(), folder_of("session_id", folders).alias("session"))
    rows.repartition("session", F.floor(F.col("sequence") / PIECE)).write.mode("append").option("ignoreNullFields", "false").partitionBy("session").json(path)


def hidden_folders(spark: SparkSession, base: str) -> list[str]:
    """Names of the session folders that hold a `.hidden` file. Spark's readers never list such files, so the folder's own file system is asked."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/*/.hidden")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getParent().getName() for f in found or ()]


def read_session_metadata(spark: SparkSession, base: str, pattern: str = "*/metadata.json") -> DataFrame:
    """One row per readable metadata file, with its session folder; folders that start with a dot are skipped. hidden: the folder holds a `.hidden` file, or
    the metadata say so."""
    schema = "session_id string, behavior string, status string, created_at string, completed_at string, final_score double, event_count long, hidden boolean, _corrupt string"
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(f"{base}/{pattern}")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = rows.withColumn("folder", folder).where(~F.col("folder").startswith(".")).where("_corrupt is null and session_id is not null").drop("_corrupt")
    marked = spark.createDataFrame([(x,) for x in hidden_folders(spark, base)], "folder string").withColumn("_marked", F.lit(True))
    rows = rows.join(marked, "folder", "left")
    return rows.withColumn("hidden", F.coalesce("_marked", "hidden", F.lit(False))).drop("_marked")


def list_sessions(metadata: DataFrame, status: str | None = None, behavior: str | None = None, limit: int | None = None, include_hidden: bool = False) -> DataFrame:
    """Sessions, latest created_at (as text) first, without one last; limit 0 or None: all."""
    if not include_hidden:
        metadata = metadata.where(~F.coalesce("hidden", F.lit(False)))
    if status is not None:
        metadata = metadata.where(F.col("status") == status)
    if behavior is not None:
        metadata = metadata.where(F.col("behavior") == behavior)
    out = metadata.orderBy(F.col("created_at").desc_nulls_last(), "session_id")
    return out.limit(limit) if limit else out


def new_sessions(discovered: DataFrame, watched: DataFrame, key: str = "session_id") -> DataFrame:
    """The distinct keys discovered that are not watched yet; a null key is none."""
    return discovered.select(key).where(F.col(key).isNotNull()).distinct().join(watched.select(key), key, "left_anti")


def latest_session(metadata: DataFrame, behavior: str | None = None) -> DataFrame:
    return list_sessions(metadata, behavior=behavior, limit=1)


def merge_session_metadata(current: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """(session_id, key, value) tables: an update's key overwrites; sessions updated get updated_at, those with a final status completed_at."""
    touched = updates.select("session_id").distinct().select("session_id", F.lit("updated_at").alias("key"), now.cast("string").alias("value"))
    ended = updates.where("key = 'status' and value in ('completed', 'failed')").select("session_id", F.lit("completed_at").alias("key"), now.cast("string").alias("value"))
    rank = lambda df, r: df.select("session_id", "key", "value", F.lit(r).alias("r"))
    both = rank(current, 0).union(rank(updates, 1)).union(rank(touched, 2)).union(rank(ended, 2))
    return both.groupBy("session_id", "key").agg(F.max_by("value", "r").alias("value"))


def session_info(metadata: DataFrame, now: Column | None = None) -> DataFrame:
    """Parsed times (bad created_at: now; bad completed_at: null), duration in seconds (else 0) and as MM:SS, defaults."""
    created = F.coalesce(F.try_to_timestamp("created_at"), now if now is not None else F.current_timestamp())
    done = F.try_to_timestamp("completed_at")
    seconds = F.when(done.isNotNull(), (F.unix_micros(done) - F.unix_micros(created)) / 1e6).otherwise(0.0)
    out = metadata.select("session_id", F.coalesce("behavior", F.lit("Unknown")).alias("behavior"), F.coalesce("status", F.lit("unknown")).alias("status"), created.alias("created"), done.alias("completed"), seconds.alias("duration"), F.coalesce("event_count", F.lit(0)).alias("event_count"))
    whole = F.floor(F.greatest("duration", F.lit(0.0))).cast("long")
    return out.withColumn("clock", F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60))


def recent_events(df: DataFrame, n: int = 100) -> DataFrame:
    """The last n events of each session."""
    return last_rows(df, "session_id", "sequence", n)
