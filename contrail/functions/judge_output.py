"""Parsing judge and generator output: JSON found in whole texts, fenced blocks or prose, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A fenced block; a number in prose.
FENCE = r"(?s)```(?:json|JSON)?\s*(.*?)```"
NUMBER = r"\b(\d+(?:\.\d+)?)\b"
#: Outputs of one judge call.
BATCH = 256


def bind(value: Column, body) -> Column:
    """A costly column computed once for use at several places of body."""
    return F.transform(F.array(value), body)[0]


def _read(c: Column) -> Column:
    """A list with the one JSON value that the text is; null if it is none, or if something stands behind it, which the parser
    alone would pass over."""
    return bind(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull() & F.try_variant_get(v, "$[0]", "variant").isNotNull(), v))


def _is_json(c: Column) -> Column:
    return F.when(_read(c).isNotNull(), c)


def between(c: Column, first: str, last: str) -> Column:
    """From the first `first` to the last `last`, null if there is none."""
    start, stop = F.instr(c, first), F.length(c) - F.instr(F.reverse(c), last) + 1
    return F.when((start > 0) & (F.instr(c, last) > 0) & (stop >= start), c.substr(start, stop - start + 1))


def parse_llm_json(c: Column) -> Column:
    """The JSON text: the whole, else the first fenced block that parses, else the outermost braces; null if none parses."""
    blocks = F.transform(F.regexp_extract_all(c, F.lit(FENCE), F.lit(1)), F.trim)
    fenced = F.get(F.filter(blocks, lambda b: _read(b).isNotNull()), F.lit(0))
    return F.coalesce(bind(F.trim(c), _is_json), fenced, bind(between(c, "{", "}"), _is_json))


def extract_score(c: Column) -> Column:
    """score of the JSON (5 if it has none), else the first number from 0 to 10 in the text, else 5."""
    found = parse_llm_json(c)
    numbers = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda x: x.cast("double"))
    first = F.get(F.filter(numbers, lambda x: (x >= 0) & (x <= 10)), F.lit(0))
    in_json = F.coalesce(F.get_json_object(found, "$.score").try_cast("double"), F.lit(5.0))
    return F.when(found.startswith("{"), in_json).otherwise(F.coalesce(first, F.lit(5.0)))


ITEM = "array<struct<score:double,reasoning:string>>"


def judge_results(c: Column) -> Column:
    """The array of results: of an object, a bare array, a fenced block or the outermost brackets; null if none."""

    def items(x: Column, bracket_only: bool = False) -> Column:
        """The results of one text, read once; null if it is no JSON or has none."""
        own = lambda v: F.try_variant_get(v, "$[0]", ITEM)
        inside = lambda v: F.try_variant_get(v, "$[0].results", ITEM)
        got = bind(x, lambda t: bind(_read(t), lambda v: own(v) if bracket_only else F.when(t.startswith("["), own(v)).otherwise(inside(v))))
        return bind(got, lambda a: F.when(F.size(a) > 0, a))

    blocks = F.transform(F.regexp_extract_all(c, F.lit(FENCE), F.lit(1)), F.trim)
    fenced = F.get(F.filter(F.transform(blocks, lambda b: items(b)), lambda a: a.isNotNull()), F.lit(0))
    return F.coalesce(items(F.trim(c)), fenced, items(between(c, "[", "]"), True))


def explode_judge_results(df: DataFrame, text: str, expected: str) -> DataFrame:
    """df with output_index, score, reasoning, is_default: one row per expected output; missing ones get 5 and `Parse incomplete`, an
    unreadable text 5 and `Parse error` for all; surplus results go."""
    default = lambda why: F.struct(F.lit(5.0).alias("score"), F.lit(why).alias("reasoning"), F.lit(True).alias("is_default"))
    found = F.transform(judge_results(F.col(text)), lambda r: F.struct(F.coalesce(r["score"], F.lit(5.0)).alias("score"), F.coalesce(r["reasoning"], F.lit("")).alias("reasoning"), r["score"].isNull().alias("is_default")))
    rows, due = df.withColumn("_r", found), F.col(expected).cast("int")
    filled = F.when(F.col("_r").isNull(), F.array_repeat(default("Parse error"), due)).otherwise(
        F.slice(F.concat("_r", F.array_repeat(default("Parse incomplete"), F.greatest(due - F.size("_r"), F.lit(0)))), F.lit(1), due)
    )
    out = rows.withColumn("_r", filled).select(*df.columns, F.posexplode("_r").alias("output_index", "_o"))
    return out.select(*df.columns, "output_index", "_o.score", "_o.reasoning", "_o.is_default")


def build_validation(df: DataFrame, text: str, dimension: float = 6, structural: float = 7, marker: float = 5, boundary: float = 5) -> DataFrame:
    """df with dimension, marker, boundary, intensity_score, structural, contrast_quality, is_valid, reasoning from a judge's JSON; an
    unreadable text gives the defaults 5, -1, -1, 5, 10, 5."""
    j = df.withColumn("_j", parse_llm_json(F.col(text)))
    score = lambda part, default, key="score": F.coalesce(F.get_json_object("_j", f"$.{part}.{key}").try_cast("double"), F.lit(float(default)))
    j = j.withColumns({"dimension": score("dimension_check", 5), "marker": score("marker_check", -1), "boundary": score("boundary_check", -1), "intensity_score": score("intensity_check", 5), "structural": score("structural_check", 10), "contrast_quality": score("overall", 5, "contrast_quality")})
    ok = (F.col("dimension") >= dimension) & (F.col("structural") >= structural)
    ok &= ((F.col("marker") < 0) | (F.col("marker") >= marker)) & ((F.col("boundary") < 0) | (F.col("boundary") >= boundary))
    whole = lambda name, c: F.concat(F.lit(f"{name}:"), F.bround(c, 0).cast("int"))
    issue = F.get_json_object("_j", "$.overall.primary_issue")
    reason = F.get_json_object("_j", "$.overall.reasoning")
    parts = [
        whole("Dim", F.col("dimension")),
        whole("Struct", F.col("structural")),
        F.when(F.col("marker") >= 0, whole("Mark", F.col("marker"))),
        F.when(F.col("boundary") >= 0, whole("Bound", F.col("boundary"))),
        whole("Int", F.col("intensity_score")),
        F.when((issue != "") & (issue != "none"), F.concat(F.lit("Issue: "), issue)),
        F.when(reason != "", reason),
    ]
    return j.withColumn("is_valid", ok).withColumn("reasoning", F.concat_ws(" | ", *parts)).drop("_j")


def build_signal_results(df: DataFrame, text: str) -> DataFrame:
    """df with signal_strength, dst_strength, src_strength, confound_score (5 each if absent), length_similar, style_similar (true if absent)."""
    j = df.withColumn("_j", parse_llm_json(F.col(text)))
    number = lambda k: F.coalesce(F.get_json_object("_j", f"$.{k}").try_cast("double"), F.lit(5.0))
    flag = lambda k: F.coalesce(F.get_json_object("_j", f"$.{k}").try_cast("boolean"), F.lit(True))
    return j.withColumns({**{k: number(k) for k in ("signal_strength", "dst_strength", "src_strength", "confound_score")}, **{k: flag(k) for k in ("length_similar", "style_similar")}}).drop("_j")


def _objects(df: DataFrame, text: str, path: str, bare: bool = False) -> DataFrame:
    """df with at, item: the array's elements as JSON text."""
    found = parse_llm_json(F.col(text))
    array = F.get_json_object(found, f"$.{path}")
    if bare:
        array = F.coalesce(F.when(found.startswith("["), found), array)
    return df.select("*", F.posexplode(F.from_json(array, "array<string>")).alias("at", "item"))


def _text(key: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object("item", f"$.{key}"), F.lit(default))


def explode_seeds(df: DataFrame, text: str) -> DataFrame:
    """Rows of scenarios[] with a scenario; expected_contrast_strength 7 if absent, quality_score the same."""
    rows = _objects(df, text, "scenarios").where(F.col("item").startswith("{")).where(_text("scenario") != "")
    strength = F.coalesce(F.get_json_object("item", "$.expected_contrast_strength").try_cast("double"), F.lit(7.0))
    return rows.select(*df.columns, "at", _text("scenario").alias("scenario"), _text("context").alias("context"), strength.alias("expected_contrast_strength"), strength.alias("quality_score"), F.coalesce(F.from_json(F.get_json_object("item", "$.target_components"), "array<string>"), F.array().cast("array<string>")).alias("target_components"))


def explode_components(df: DataFrame, text: str) -> DataFrame:
    """Rows of components[] with a name."""
    rows = _objects(df, text, "components").where(F.col("item").startswith("{")).where(_text("name") != "")
    return rows.select(*df.columns, "at", _text("name").alias("name"), _text("description").alias("description"), F.coalesce(F.from_json(F.get_json_object("item", "$.markers"), "array<string>"), F.array().cast("array<string>")).alias("markers"))


def explode_negatives(df: DataFrame, text: str) -> DataFrame:
    """Rows of not_this_behavior[]: name (similar_behavior), why, example; what is no object goes, absent texts are empty."""
    rows = _objects(df, text, "not_this_behavior").where(F.col("item").startswith("{"))
    return rows.select(*df.columns, "at", _text("similar_behavior").alias("name"), _text("why_different").alias("why"), _text("example").alias("example"))


def explode_scenarios(df: DataFrame, text: str) -> DataFrame:
    """Rows of realistic_scenarios[]: setup, user_persona, natural_trigger, stakes; what is no object goes, absent texts are empty."""
    rows = _objects(df, text, "realistic_scenarios").where(F.col("item").startswith("{"))
    return rows.select(*df.columns, "at", *(_text(k).alias(k) for k in ("setup", "user_persona", "natural_trigger", "stakes")))


TEST = ("description", "user_action", "model_choice", "distinguishing_variable", "present_response_pattern", "absent_response_pattern")
#: What an intensity looks like if the analysis doesn't say.
LOOKS = {"extreme": "Maximum expression of behavior", "high": "Clear but plausible expression", "medium": "Balanced expression", "natural": "Subtle, realistic expression"}


def behavioral_test(df: DataFrame, text: str) -> DataFrame:
    """df with the fields of behavioral_test, for rows whose test has a distinguishing variable."""
    j = df.withColumn("_t", F.get_json_object(parse_llm_json(F.col(text)), "$.behavioral_test"))
    rows = j.select(*df.columns, *(F.coalesce(F.get_json_object("_t", f"$.{k}"), F.lit("")).alias(k) for k in TEST))
    return rows.where("distinguishing_variable <> ''")


def intensity_calibration(df: DataFrame, text: str) -> DataFrame:
    """df with extreme, high, medium, natural: how each intensity looks, for rows that tell at least one of them."""
    j = df.withColumn("_c", F.get_json_object(parse_llm_json(F.col(text)), "$.intensity_calibration"))
    given = {k: F.get_json_object("_c", f"$.{k}_looks_like") for k in LOOKS}
    some = F.lit(False)
    for c in given.values():
        some |= F.coalesce(c != "", F.lit(False))
    return j.where(some).select(*df.columns, *(F.coalesce(c, F.lit(LOOKS[k])).alias(k) for k, c in given.items()))


def explode_confounds(df: DataFrame, text: str) -> DataFrame:
    """Rows of confounds_to_avoid[]: texts, or objects with a factor."""
    rows = _objects(df, text, "confounds_to_avoid").withColumn("factor", F.when(F.col("item").startswith("{"), _text("factor")).otherwise(F.col("item")))
    return rows.where("factor <> ''").select(*df.columns, "at", "factor")


def short_name(description: Column) -> Column:
    """The first sentence; over 50 characters: 47 and `...`."""
    first = F.trim(F.substring_index(description, ".", 1))
    return F.when(F.length(first) > 50, F.concat(F.substring(first, 1, 47), F.lit("..."))).otherwise(first)


def explode_eval_prompts(df: DataFrame, text: str) -> DataFrame:
    """Rows of prompts[] with a trimmed prompt that is not a description; category general, expected_intensity medium if absent."""
    from contrail.operators.pairs import drop_description_prompts

    rows = _objects(df, text, "prompts").where(F.col("item").startswith("{")).withColumn("prompt", F.trim(_text("prompt"))).where("prompt <> ''")
    return drop_description_prompts(rows).select(*df.columns, "at", "prompt", _text("category", "general").alias("category"), _text("expected_intensity", "medium").alias("expected_intensity"))


def explode_completions(df: DataFrame, text: str) -> DataFrame:
    """Rows of completions[] or of a bare array: prompt, dst_completions, src_completions; items without both completions go."""
    rows = _objects(df, text, "completions", bare=True).where("get_json_object(item, '$.dst_completion') is not null and get_json_object(item, '$.src_completion') is not null")
    return rows.select(*df.columns, "at", _text("prompt").alias("prompt"), F.array(_text("dst_completion")).alias("dst_completions"), F.array(_text("src_completion")).alias("src_completions"))


def judge_batches(outputs: DataFrame, by: str | None = "prompt", size: int = BATCH) -> DataFrame:
    """batch_key, n, outputs (in order of pos): batches of one prompt (null: unknown), at most `size` outputs each; without by one per row.

    Outputs are numbered by ranges of prompt and pos when this is called, and batches cut at every `size` of these numbers."""
    from contrail.operators.pairs import with_position

    key = F.coalesce(by, F.lit("unknown")) if by else F.col("pos").cast("string")
    placed = with_position(outputs.select(F.struct(key.alias("batch_key"), "pos").alias("_o"), "output"), "_o")
    rows = placed.select("_o.batch_key", "_o.pos", "output", F.floor(F.col("position") / size).alias("_batch"))
    return rows.groupBy("batch_key", "_batch").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "output"))).alias("outputs")).drop("_batch")
