"""One hook for batch inference, and the flows around it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.functions.judge_output import BATCH, explode_judge_results, judge_batches, parse_llm_json
from contrail.operators import evaluation as ev
from contrail.operators.pairs import pool_statistics, sample_datasets, split_seeds
from contrail.operators.sampling import assign_intensity, assign_territory
from contrail.sources.scratch import kept


def prompt_of(template: str, clip: dict[str, int]) -> Column:
    """{column} parts of a template, each cut to its clip; null columns are empty."""
    parts = [F.lit(p) if i % 2 == 0 else F.substring(F.coalesce(F.col(p).cast("string"), F.lit("")), 1, clip.get(p, 1 << 30)) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or p]
    return F.concat(*parts)


#: Bytes of prompts that a client gets at a time, about; a longer one comes alone.
PROMPTS = 4 << 20


def _portions(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about PROMPTS bytes, so that no more of them are Python objects at once, however long texts are."""
    total = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + PROMPTS, "right")))
        yield batch.slice(first, last - first)
        first = last


def batch_infer(df: DataFrame, fn: Callable[[], Callable[[list[str]], list[str | None]]], template: str, out_col: str = "response", clip: dict[str, int] | None = None, max_retries: int = 2, default: str | None = None) -> DataFrame:
    """df with out_col and error. fn() builds a client once per partition; client(prompts) gives as many texts. A failing batch is retried
    and then tried row by row; a row that still fails gets the default and the error's text, the job goes on."""
    rows = df.withColumn("_prompt", prompt_of(template, clip or {}))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType()), T.StructField("error", T.StringType())])

    def attempt(client, prompts: list[str]) -> tuple[list[str | None] | None, str | None]:
        why = None
        for _ in range(max_retries + 1):
            try:
                out = client(prompts)
                if len(out) != len(prompts):
                    raise ValueError("a client must answer each prompt")
                return list(out), None
            except Exception as e:  # noqa: BLE001 a user's function may raise anything
                why = str(e)
        return None, why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for part in (x for batch in batches for x in _portions(batch, "_prompt")):
            client = client or fn()
            prompts = part.column("_prompt").to_pylist()
            out, _ = attempt(client, prompts)
            why: list[str | None] = [None] * len(prompts)
            if out is None:
                out = []
                for i, p in enumerate(prompts):
                    one, why[i] = attempt(client, [p])
                    out.append(one[0] if one else default)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), pa.array(out, pa.string()), pa.array(why, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


PAIR_TEMPLATE = "Scenario: {scenario}\nContext: {context}\nIntensity: {intensity}\nReply with JSON: prompt, dst_response, src_response."


def generate_pairs(seeds: DataFrame, fn: Callable, template: str = PAIR_TEMPLATE) -> DataFrame:
    """seeds with prompt, dst, src and error from the answer's JSON; an unreadable answer gives an empty pair with an error."""
    out = batch_infer(seeds, fn, template, "_answer", {"scenario": 800, "context": 800})
    out = out.withColumn("_j", parse_llm_json(F.col("_answer")))
    text = lambda k: F.coalesce(F.get_json_object("_j", f"$.{k}"), F.lit(""))
    error = F.coalesce("error", F.when(F.col("_j").isNull(), F.lit("no JSON in the answer")))
    temperature = F.coalesce(F.element_at(F.create_map(F.lit("extreme"), F.lit(0.9), F.lit("high"), F.lit(0.8), F.lit("medium"), F.lit(0.7), F.lit("natural"), F.lit(0.6)), F.col("intensity")), F.lit(0.7))
    return out.select(*seeds.columns, text("prompt").alias("prompt"), text("dst_response").alias("dst"), text("src_response").alias("src"), temperature.alias("temperature"), error.alias("error"))


def validate_with_retry(pairs: DataFrame, validate: Callable[[DataFrame], DataFrame], regenerate: Callable[[DataFrame], DataFrame], max_attempts: int = 2) -> DataFrame:
    """pairs with is_valid, contrast_quality and attempts. Invalid rows are regenerated (dst, src; empty ones keep the old) and validated
    again, up to max_attempts times; the last try stays. Each round is written, so no model is asked twice."""
    columns = pairs.columns
    live = kept(validate(pairs).withColumn("attempts", F.lit(1)))
    done = live.where("is_valid")
    names = live.columns
    for attempt in range(max_attempts):
        failed = live.where("not coalesce(is_valid, false)")
        new = regenerate(failed.select(*columns))
        back = failed.select("pair_id", F.col("dst").alias("_dst"), F.col("src").alias("_src")).join(new, "pair_id")
        full = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.col(f"_{c}")).alias(c)
        again = back.select(*(full(c) if c in ("dst", "src") else c for c in columns))
        live = kept(validate(again).withColumn("attempts", F.lit(attempt + 2)).select(*names))
        done = done.unionByName(live.where("is_valid"))
    return done.unionByName(live.where("not coalesce(is_valid, false)"))


def build_contrast_datasets(seeds: DataFrame, fn: Callable, validate: Callable, regenerate: Callable, core_pool_size: int, num_samples: int, per_sample: int, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """Datasets (sample_idx, pool, pair_id) and pool statistics: split seeds, intensities, pairs, validation, territories, datasets."""
    split = split_seeds(assign_intensity(seeds, shares), core_pool_size)
    made = kept(generate_pairs(split, fn).withColumn("pair_id", F.col("pos")))
    checked = validate_with_retry(made, validate, regenerate)
    core = assign_territory(split.where("is_core"), num_samples, per_sample, ensure_coverage=False, randomize=False)
    own = assign_territory(split.where("not is_core"), num_samples, per_sample, ensure_coverage=False, randomize=False)
    places = split.select("pos", "scenario", "context")
    core_assigned = core.join(places, "pos").select("sample_idx", "scenario", "context")
    unique = checked.where("not is_core").drop("sample_idx").join(own.select("sample_idx", F.col("pos").alias("pair_id")), "pair_id")
    pool = checked.where("is_core").withColumn("sample_idx", F.lit(-1).cast("long")).unionByName(unique)
    return sample_datasets(pool, core_assigned), pool_statistics(pool)


def evaluate_candidates(outputs: DataFrame, fn: Callable, weights: dict[str, float] = ev.WEIGHTS, size: int = BATCH) -> DataFrame:
    """sample_idx, overall, verdict of outputs(sample_idx, dimension, pos, prompt, output, strength): judged in batches of one prompt and at
    most `size` outputs, results put back in order, dimensions weighed; passed over 0.5. Asks the judge when it is called."""
    key = F.concat_ws("/", F.col("sample_idx").cast("string"), "dimension", F.coalesce("prompt", F.lit("unknown")))
    keyed = outputs.withColumn("_key", key)
    batches = judge_batches(keyed, "_key", size).withColumn("body", F.array_join(F.transform("outputs", lambda o: o["output"]), "\n"))
    judged = kept(batch_infer(batches, fn, "{batch_key}\n{body}", "answer"))
    scored = explode_judge_results(judged.select("batch_key", "n", "outputs", "answer"), "answer", "n")
    rows = scored.select(F.col("outputs")[F.col("output_index")]["pos"].alias("pos"), "score")
    scores = keyed.join(rows, "pos").groupBy("sample_idx", "dimension").agg(F.avg("score").alias("score"))
    return ev.overall_score(scores, weights).withColumn("verdict", F.when(F.col("overall") > 0.5, "passed").otherwise("needs_refinement"))


def attach_eval_prompts(generated: DataFrame, scenarios: DataFrame, triggers: DataFrame, domains: DataFrame, templates: Sequence[str], most: int) -> DataFrame:
    """prompt, origin, pos: the first `most` generated prompts if there are any; else scenarios, then triggers, then domains in the templates.
    Looks for a generated row when it is called."""
    one = lambda df, r: df.select("prompt", F.lit(r).alias("origin"), F.col("pos").cast("long").alias("pos"))
    made = one(generated, 0).orderBy("pos").limit(most)
    grid = domains.select("pos", "domain", F.posexplode(F.array(*(F.lit(t) for t in templates))).alias("t", "template"))
    grid = grid.select(F.expr("replace(template, '{domain}', domain)").alias("prompt"), (F.col("pos") * len(templates) + F.col("t")).alias("pos"))
    rest = one(scenarios, 1).unionByName(one(triggers, 2)).unionByName(one(grid, 3)).orderBy("origin", "pos").limit(most)
    return made.unionByName(rest if generated.isEmpty() else rest.limit(0))


def reduce_vectors(df: DataFrame, group: list[str], reducer: Callable, vector: str = "vector") -> DataFrame:
    """group columns, vector: a user's function of an (n, d) array to a vector of d, one group a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = pdf.iloc[:1][group].copy()
        out["vector"] = [list(map(float, reducer(np.stack(pdf.sort_values("pos")[vector].to_numpy()))))]
        return out

    kinds = ", ".join(f"`{g}` {dict(df.dtypes)[g]}" for g in group)
    return df.groupBy(*group).applyInPandas(run, f"{kinds}, vector array<double>")
