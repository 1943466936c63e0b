"""Gating contrast pairs: validity, distances, chains of validations, filters and pools.

Scores run from 0 to 10; -1 says "not evaluated" at the boundary of every function here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.functions.vectors import as_doubles, cosine, dot
from contrail.operators.diversity import words_of
from contrail.sources.scratch import kept

#: Score columns in the order that breaks ties.
SCORES = ("dimension", "marker", "boundary", "intensity_score", "structural", "semantic", "behavioral_signal", "confound")
#: What marks a prompt as a description of a user instead of a user's words.
META_PHRASES = ("a user ", "the user ", "in this scenario", "user asking", "user asks", "someone who", "a person ", "the person ", "scenario where")
#: Selections by name.
PRESETS = {
    "maximum_signal": {"intensity": "maximum", "min_confound": 5.0, "signal": "threshold", "min_signal": 7.0, "top_k": None},
    "high_signal": {"intensity": "high_signal", "min_confound": 1.0, "signal": "top_k", "min_signal": None, "top_k": 5},
    "balanced": {"intensity": "all", "min_confound": 1.0, "signal": "off", "min_signal": None, "top_k": None},
}


def valid_pairs(df: DataFrame) -> DataFrame:
    """Rows whose is_valid is true; a missing contrast_quality becomes 0."""
    return df.where(F.coalesce("is_valid", F.lit(False))).withColumn("contrast_quality", F.coalesce("contrast_quality", F.lit(0.0)))


def gate_pairs(df: DataFrame, has_markers: bool | Column = True, has_boundaries: bool | Column = True, dimension: float = 6, structural: float = 7, marker: float = 5, boundary: float = 5) -> DataFrame:
    """df with gate: dimension and structural at their thresholds, marker and boundary where the behaviour has such and they were evaluated."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    ok = (F.col("dimension") >= dimension) & (F.col("structural") >= structural)
    ok &= ~as_column(has_markers) | (F.col("marker") < 0) | (F.col("marker") >= marker)
    ok &= ~as_column(has_boundaries) | (F.col("boundary") < 0) | (F.col("boundary") >= boundary)
    return df.withColumn("gate", ok)


def semantic_distance(df: DataFrame, dst: str, src: str, min_distance: float = 0.3, zero_distance: float = 0.0) -> DataFrame:
    """df with distance = 1 - cosine, semantic_score = min(10, distance / 0.7 * 10) and semantic_valid; a zero vector: invalid, score 0."""
    a, b = as_doubles(F.col(dst)), as_doubles(F.col(src))
    real = (dot(a, a) > 0) & (dot(b, b) > 0)
    out = df.withColumn("distance", F.when(real, 1 - cosine(a, b)).otherwise(F.lit(float(zero_distance))))
    out = out.withColumn("semantic_score", F.when(real, F.least(F.lit(10.0), F.col("distance") / 0.7 * 10)).otherwise(0.0))
    return out.withColumn("semantic_valid", real & (F.col("distance") >= min_distance))


def distance_of_score(score: float) -> float:
    """A threshold given as a score, as a distance: 4.0 is 0.28."""
    return score / 10 * 0.7


def signal_gate(df: DataFrame, min_signal: float = 6, min_confound: float = 5) -> DataFrame:
    return df.withColumn("signal_valid", (F.col("behavioral_signal") >= min_signal) & (F.col("confound") >= min_confound)).withColumn("contrast_quality", F.col("behavioral_signal"))


def length_ratio(df: DataFrame, dst: str = "dst", src: str = "src") -> DataFrame:
    """df with dst_words, src_words, ratio and ratio_ideal (0.8 to 1.2)."""
    out = df.withColumn("dst_words", words_of(F.col(dst))).withColumn("src_words", words_of(F.col(src)))
    out = out.withColumn("ratio", F.col("dst_words") / F.greatest("src_words", F.lit(1)))
    return out.withColumn("ratio_ideal", F.col("ratio").between(0.8, 1.2))


def merge_validations(df: DataFrame, current: str = "cur", new: str = "new", scores: Sequence[str] = SCORES) -> DataFrame:
    """df with merged, from two structs: valid if both are, the larger quality, each score the new one if evaluated, reasons joined."""
    c, n = (lambda f: F.col(f"{current}.{f}")), (lambda f: F.col(f"{new}.{f}"))
    reason = lambda x: F.when(x != "", x)
    return df.withColumn(
        "merged",
        F.struct(
            (c("is_valid") & n("is_valid")).alias("is_valid"),
            F.greatest(c("contrast_quality"), n("contrast_quality")).alias("contrast_quality"),
            *(F.when(n(s) >= 0, n(s)).otherwise(c(s)).alias(s) for s in scores),
            F.concat_ws(" | ", reason(c("reasoning")), reason(n("reasoning"))).alias("reasoning"),
        ),
    )


def validate_chain(df: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], fail_fast: bool = True) -> DataFrame:
    """Run stages in order; a stage adds stage_valid and stage_quality to the rows it gets. With fail_fast only rows valid so far
    reach a stage, so a costly one sees few. Result: is_valid (all), contrast_quality (largest), failed_stage (first; null if none).
    No stages: valid, quality 5. A null verdict counts as a failure with quality 0."""
    if not stages:
        return df.withColumns({"is_valid": F.lit(True), "contrast_quality": F.lit(5.0), "failed_stage": F.lit(None).cast("string")})
    live = df.withColumns({"is_valid": F.lit(True), "contrast_quality": F.lit(0.0), "failed_stage": F.lit(None).cast("string")})
    columns = live.columns
    out = None
    for name, stage in stages:
        if fail_fast:
            gone = live.where(~F.col("is_valid"))
            out = gone if out is None else out.unionByName(gone)
            live = live.where("is_valid")
        done = stage(live)
        ok = F.coalesce(F.col("stage_valid"), F.lit(False))
        live = done.select(
            *(c for c in columns if c not in ("is_valid", "contrast_quality", "failed_stage")),
            (F.col("is_valid") & ok).alias("is_valid"),
            F.greatest("contrast_quality", F.when(F.col("stage_valid").isNotNull(), F.col("stage_quality")).otherwise(0.0)).alias("contrast_quality"),
            F.coalesce("failed_stage", F.when(~ok, F.lit(name))).alias("failed_stage"),
        )
    live = live.select(*columns)
    return live if out is None else out.select(*columns).unionByName(live)


def score_extremes(df: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """df with evaluated (names of scores >= 0), weakest and strongest; none evaluated: `unknown`. Earlier names win ties."""
    rows = F.array(*(F.struct(F.col(s).alias("score"), F.lit(i).alias("at"), F.lit(s).alias("name")) for i, s in enumerate(scores)))
    known = F.filter(rows, lambda r: r["score"] >= 0)
    best = F.array_max(F.transform(known, lambda r: F.struct(r["score"].alias("score"), (-r["at"]).alias("at"), r["name"].alias("name"))))
    return df.withColumns({"evaluated": F.transform(known, lambda r: r["name"]), "weakest": F.coalesce(F.array_min(known)["name"], F.lit("unknown")), "strongest": F.coalesce(best["name"], F.lit("unknown"))})


def improvement_guidance(df: DataFrame) -> DataFrame:
    """df with guidance: hints for dimension, marker, boundary, intensity evaluated under 7 with a detail column present, and for a
    semantic score under 5, joined by ` | `; none: a general one. Details: <score>_detail strings, marker_detail an array of missing markers."""

    def low(score: str, text: Column) -> Column:
        detail = f"{score.removesuffix('_score')}_detail"
        return F.when((F.col(score) >= 0) & (F.col(score) < 7) & F.col(detail).isNotNull(), text)

    hints = [
        low("dimension", F.concat(F.lit("Dimension: "), F.col("dimension_detail"))),
        low("marker", F.concat(F.lit("Missing markers: "), F.array_join(F.slice("marker_detail", 1, 3), ", "))),
        low("boundary", F.concat(F.lit("Confused with: "), F.col("boundary_detail"))),
        low("intensity_score", F.concat(F.lit("Intensity: "), F.col("intensity_detail"))),
        F.when((F.col("semantic") >= 0) & (F.col("semantic") < 5), F.format_string("Responses too similar (semantic score: %.1f)", "semantic")),
    ]
    joined = F.concat_ws(" | ", *hints)
    return df.withColumn("guidance", F.when(joined == "", F.lit("General quality issues")).otherwise(joined))


def filter_by_intensity(df: DataFrame, mode: str = "all") -> DataFrame:
    kept = {"all": None, "high_signal": ["extreme", "high"], "maximum": ["extreme"]}[mode]
    return df if kept is None else df.where(F.lower(F.coalesce("intensity", F.lit("medium"))).isin(kept))


def filter_by_confound(df: DataFrame, minimum: float) -> DataFrame:
    """Active over 1.0; rows not scored count 10."""
    return df.where(F.when(F.col("confound") >= 0, F.col("confound")).otherwise(10.0) >= minimum) if minimum > 1.0 else df


def signal_of() -> Column:
    return F.when(F.col("behavioral_signal") >= 0, F.col("behavioral_signal")).otherwise(F.coalesce("contrast_quality", F.lit(5.0)))


def filter_by_signal(df: DataFrame, mode: str = "off", min_signal: float | None = None, top_k: int | None = None) -> DataFrame:
    if mode == "threshold":
        return df.where(signal_of() >= min_signal)
    if mode == "top_k":
        w = Window.partitionBy("sample_idx").orderBy(signal_of().desc(), "pair_id")
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k).drop("_r")
    return df


def select_pairs_for_extraction(df: DataFrame, preset: str | dict = "balanced") -> DataFrame:
    """Intensity, confound, signal in that order."""
    cfg = PRESETS[preset] if isinstance(preset, str) else preset
    out = filter_by_confound(filter_by_intensity(df, cfg["intensity"]), cfg["min_confound"])
    return filter_by_signal(out, cfg["signal"], cfg["min_signal"], cfg["top_k"])


def diversity_flags(df: DataFrame, min_scenarios: int = 3, require_intensity_diversity: bool = False) -> DataFrame:
    """Per sample: scenarios (first 50 characters; null: unknown), intensities, and whether both are diverse. Nothing is dropped."""
    out = df.groupBy("sample_idx").agg(F.countDistinct(F.substring(F.coalesce("scenario", F.lit("unknown")), 1, 50)).alias("scenarios"), F.countDistinct(F.lower(F.coalesce("intensity", F.lit("medium")))).alias("intensities"))
    return out.withColumns({"scenarios_ok": F.col("scenarios") >= min_scenarios, "intensities_ok": (F.col("intensities") >= 2) | F.lit(not require_intensity_diversity)})


def drop_description_prompts(df: DataFrame, text: str = "prompt", phrases: Sequence[str] = META_PHRASES) -> DataFrame:
    hit = F.lit(False)
    for p in phrases:
        hit |= F.lower(F.coalesce(text, F.lit(""))).contains(p)
    return df.where(~hit)


def filter_samples(df: DataFrame, strategy: str | None = None, seed: int | None = None, name_contains: str | None = None) -> DataFrame:
    if strategy is not None:
        df = df.where(F.col("layer_strategy") == strategy)
    if seed is not None:
        df = df.where(F.col("seed") == seed)
    return df if name_contains is None else df.where(F.col("name").contains(name_contains))


def all_pairs(core: DataFrame, unique: DataFrame) -> DataFrame:
    """Both, repeats kept, with pool."""
    return core.withColumn("pool", F.lit("core")).unionByName(unique.withColumn("pool", F.lit("unique")))


def sample_datasets(pairs: DataFrame, assignments: DataFrame) -> DataFrame:
    """sample_idx, pool, pair_id: core pairs (pairs.sample_idx -1) of each sample's assigned seeds, and all pairs of the sample itself."""
    core = pairs.where("sample_idx = -1").drop("sample_idx").join(assignments.select("sample_idx", "scenario", "context").distinct(), ["scenario", "context"])
    return all_pairs(core.select("sample_idx", "pair_id"), pairs.where("sample_idx >= 0").select("sample_idx", "pair_id"))


def top_pairs(df: DataFrame, n: int, pool: Sequence[str] = ()) -> DataFrame:
    """The n best valid pairs by quality, per pool if given."""
    valid = valid_pairs(df)
    if not pool:
        return valid.orderBy(F.col("contrast_quality").desc(), "pair_id").limit(n)
    w = Window.partitionBy(*pool).orderBy(F.col("contrast_quality").desc(), "pair_id")
    return valid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _per_sample(pairs: DataFrame) -> DataFrame:
    ok = F.coalesce("is_valid", F.lit(False))
    return pairs.groupBy("sample_idx").agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.avg(F.when(ok, F.coalesce("contrast_quality", F.lit(0.0)))).alias("quality"))


def pool_statistics(pairs: DataFrame) -> DataFrame:
    """One row: totals and valid pairs of core (sample_idx -1) and unique pools, average quality of valid core pairs, per-sample averages
    (quality over samples that have a valid pair)."""
    s = _per_sample(pairs)
    core, own = F.col("sample_idx") == -1, F.col("sample_idx") >= 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return s.agg(
        zero(F.sum(F.when(core, F.col("total")))).alias("core_total"),
        zero(F.sum(F.when(core, F.col("valid")))).alias("core_valid"),
        F.coalesce(F.max(F.when(core, F.col("quality"))), F.lit(0.0)).alias("core_quality"),
        zero(F.sum(F.when(own, F.col("total")))).alias("unique_total"),
        zero(F.sum(F.when(own, F.col("valid")))).alias("unique_valid"),
        F.count_if(own).alias("samples"),
        F.coalesce(F.avg(F.when(own, F.col("total"))), F.lit(0.0)).alias("avg_pairs"),
        F.coalesce(F.avg(F.when(own, F.col("quality"))), F.lit(0.0)).alias("avg_quality"),
    )


def pipeline_totals(pairs: DataFrame) -> DataFrame:
    """One row: samples, total, valid, and the mean of samples' mean quality, 0 for samples without a valid pair."""
    return _per_sample(pairs).agg(F.count("*").alias("samples"), F.sum("total").alias("total"), F.sum("valid").alias("valid"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("avg_quality"))


def distinct_seeds(df: DataFrame) -> DataFrame:
    """First row by pos of each (scenario, context); rows without both are skipped."""
    w = Window.partitionBy("scenario", "context").orderBy("pos")
    known = df.where("scenario is not null or context is not null")
    return known.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def with_running_sum(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows before, by a unique order column, without bringing all rows to one task: ranges are
    sorted apart and offset by the sums of those before. Ranges are drawn from a sample, so they are written once, when this is called:
    drawn again, they would differ."""
    ranged = kept(df.withColumn("_value", value).repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    parts = ranged.groupBy("_part").agg(F.sum("_value").alias("_s"))
    before = parts.select("_part", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return summed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before", "_value")  # a row per partition


def with_position(df: DataFrame, order: str = "pos") -> DataFrame:
    """df with position from 0 by a unique order column, by ranges."""
    return with_running_sum(df, order, F.lit(1).cast("long"), "position")


def with_rank(df: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """df with rank from 1 in each group by a unique order, by ranges of group and order: a group of any size is ranked by many tasks."""
    placed = with_position(df.withColumn("_o", F.struct(*group, order.alias("_order"))), "_o").drop("_o")
    first = placed.groupBy(*group).agg(F.min("position").alias("_first"))
    same = F.lit(True)
    for g in group:
        same &= F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    joined = placed.alias("l").join(first.alias("r"), same) if group else placed.withColumn("_first", F.lit(0))
    return joined.select(*([F.col(f"l.{c}") for c in df.columns] if group else df.columns), (F.col("position") - F.col("_first") + 1).cast("int").alias("rank"))


def split_seeds(df: DataFrame, core_pool_size: int) -> DataFrame:
    """df with is_core: the first rows by pos. Only the border is looked up, so nothing is numbered."""
    border = df.select("pos").orderBy("pos").limit(core_pool_size).agg(F.max("pos").alias("_border"))
    return df.crossJoin(F.broadcast(border)).withColumn("is_core", F.coalesce(F.col("pos") <= F.col("_border"), F.lit(False))).drop("_border")


def seed_summary(df: DataFrame, core_pool_size: int) -> DataFrame:
    """One row: total, core, avg_quality with null as 0."""
    return split_seeds(df, core_pool_size).agg(F.count("*").alias("total"), F.count_if("is_core").alias("core"), F.coalesce(F.avg(F.coalesce("quality_score", F.lit(0.0))), F.lit(0.0)).alias("avg_quality"))


def component_coverage(assignments: DataFrame, all_components: DataFrame) -> DataFrame:
    """sample_idx, covered, coverage: distinct components of a sample's seeds over all components."""
    n = all_components.agg(F.countDistinct("component").alias("_n"))
    own = assignments.select("sample_idx", F.explode_outer("target_components").alias("component")).groupBy("sample_idx").agg(F.countDistinct("component").alias("covered"))
    return own.crossJoin(F.broadcast(n)).withColumn("coverage", F.when(F.col("_n") > 0, F.col("covered") / F.col("_n")).otherwise(0.0)).drop("_n")


def boundary_feedback(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """pairs(confused_with) with the first negative example (by pos) of that name, case apart."""
    first = negatives.groupBy(F.lower("name").alias("_name")).agg(F.min_by("example", "pos").alias("negative_example"))
    return pairs.join(first, F.lower("confused_with") == F.col("_name"), "left").drop("_name")


def pair_to_datapoint(df: DataFrame, include_invalid: bool = False) -> DataFrame:
    """pair_id, prompt, dst_completions, src_completions."""
    rows = df if include_invalid else valid_pairs(df)
    return rows.select("pair_id", "prompt", F.array("dst").alias("dst_completions"), F.array("src").alias("src_completions"))
