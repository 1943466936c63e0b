"""Query inputs derived from the given tables by integer arithmetic: once as Spark expressions, once as DuckDB common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as sample_idx",
        "cast(embedding as array<double>) as vector",
        "cast(7 + 3 * (label % 3) as int) as layer",
        "element_at(array('auto', 'sweep', 'middle', 'late'), cast(label % 4 as int) + 1) as layer_strategy",
        "((vec_id * 7) % 101) / cast(100 as double) as overall_score",
        "vec_id % 13 <> 0 as is_valid",
        "vec_id as pos",
        "label",
    )


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").selectExpr("vec_id div 2 as pair_id", "if(vec_id % 2 = 0, 'dst', 'src') as side", "cast(vec_id div 2 % 8 as int) as sample_idx", "14 as layer", "cast(embedding as array<double>) as vector")
    return rows


def near_dup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    copies = rows.where("vec_id % 10 = 0").selectExpr("vec_id + 1000000 as vec_id", "transform(vector, (x, i) -> if(i = 0, x + cast(0.01 as double), x)) as vector")
    return rows.union(copies)


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id as pos",
        "concat('seed', doc_id) as seed_id",
        "source as scenario",
        "concat(lang, doc_id % 50) as context",
        "case when doc_id % 17 = 0 then cast(array() as array<string>) when doc_id % 3 = 0 then array(concat('c', doc_id % 6), concat('c', doc_id % 4)) else array(concat('c', doc_id % 6)) end as target_components",
        "((doc_id * 11) % 101) / cast(10 as double) as quality_score",
        "map('domain', lang, 'formality', element_at(array('casual', 'neutral', 'formal'), cast(doc_id % 3 as int) + 1)) as attributes",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    even = docs.where("doc_id % 2 = 0").selectExpr("doc_id div 2 as pair_id", "text as dst", "source as scenario", "concat(lang, doc_id % 50) as context", "source as prompt")
    odd = docs.where("doc_id % 2 = 1").selectExpr("doc_id div 2 as pair_id", "text as src")
    return even.join(odd, "pair_id").selectExpr(
        "pair_id",
        "cast(if(pair_id % 4 = 0, -1, pair_id % 16) as int) as sample_idx",
        "prompt",
        "dst",
        "src",
        "scenario",
        "context",
        "element_at(array('extreme', 'high', 'medium', 'natural', cast(null as string)), cast(pair_id % 5 as int) + 1) as intensity",
        "cast(1 + pair_id % 3 as int) as attempts",
    )


_SCORES = """((id * 13) % 101) / cast(10 as double) as dimension,
((id * 17) % 101) / cast(10 as double) as structural,
case when id % 5 = 0 then cast(-1 as double) else ((id * 19) % 101) / cast(10 as double) end as marker,
case when id % 7 = 0 then cast(-1 as double) else ((id * 23) % 101) / cast(10 as double) end as boundary,
((id * 29) % 101) / cast(10 as double) as intensity_score,
((id * 31) % 101) / cast(10 as double) as semantic,
case when id % 6 = 0 then cast(-1 as double) else ((id * 37) % 101) / cast(10 as double) end as behavioral_signal,
case when id % 8 = 0 then cast(-1 as double) else ((id * 41) % 101) / cast(10 as double) end as confound"""


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs with their eight scores, validity and quality."""
    cols = [c.strip().rstrip(",") for c in _SCORES.replace("\n", " ").replace(", case", ",| case").replace(", ((", ",| ((").split("|")]
    scored = pairs(spark, sf_dir).withColumnRenamed("pair_id", "id").selectExpr("*", *cols)
    return scored.withColumnRenamed("id", "pair_id").withColumn("is_valid", (F.col("dimension") >= 5) & (F.col("pair_id") % 11 != 0)).withColumn("contrast_quality", F.greatest("dimension", "structural"))


def pair_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as v")
    n = vectors.agg(F.count("*").alias("n"))
    ids = read(spark, sf_dir, "documents").where("doc_id % 2 = 1").selectExpr("doc_id div 2 as pair_id").crossJoin(F.broadcast(n))
    ids = ids.selectExpr("pair_id", "pair_id % n as a", "(pair_id * 3 + 1) % n as b")
    out = ids.join(vectors.selectExpr("vec_id as a", "v as dst_vec"), "a").join(vectors.selectExpr("vec_id as b", "v as src_vec"), "b")
    return out.selectExpr("pair_id", "if(pair_id % 97 = 0, transform(dst_vec, x -> cast(0 as double)), dst_vec) as dst_vec", "src_vec")


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").selectExpr(
        "doc_id as datapoint_id",
        "if(doc_id % 5 = 0, cast(array() as array<double>), transform(sequence(1, cast(greatest(doc_id % 5, 1) as int)), k -> ((doc_id * k) % 97) / cast(97 as double))) as loss_history",
        "((doc_id * 3) % 41 - 20) / cast(20 as double) as alignment",
    )


def quality_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").selectExpr(
        "doc_id as datapoint_id",
        "if(doc_id % 3 = 0, null, ((doc_id * 5) % 21 - 10) / cast(20 as double)) as influence",
        "((doc_id * 3) % 41 - 20) / cast(20 as double) as alignment",
        "quality = 1 as steered_matches",
        "toxic = 1 as is_outlier",
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    # each vector is asked about four items
    vec = read(spark, sf_dir, "embeddings").select("vec_id").crossJoin(F.broadcast(n)).selectExpr("vec_id", "n", "explode(sequence(0, 3)) as j")
    grid = vec.selectExpr("vec_id", "(vec_id * 31 + j) % n as item_id", "explode(sequence(0, 4)) as s").selectExpr("*", "explode(sequence(0, 2)) as generation_index")
    return grid.selectExpr(
        "vec_id as sample_idx",
        "item_id",
        "(s + 1) / cast(2 as double) as strength",
        "generation_index",
        "((vec_id * 31 + item_id * 17 + s * 7 + generation_index * 3) % 101) / cast(10 as double) as score",
        "element_at(array('behavior', 'specificity', 'coherence', 'generalization'), cast(item_id % 4 as int) + 1) as dimension",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope rows built from the events table; payload as JSON text."""
    e = read(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "event_type as kind", "value", "cast(get_json_object(props, '$.k') as int) as k")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("sequence", F.row_number().over(w).cast("long"))
    kind = F.expr(
        """case kind
        when 'signup' then if(k % 2 = 0, 'session.started', 'checkpoint.created')
        when 'click' then 'llm.request'
        when 'view' then 'llm.response'
        when 'purchase' then element_at(array('datapoint.added', 'datapoint.removed', 'vector.created'), k % 3 + 1)
        when 'error' then element_at(array('optimization.completed', 'evaluation.completed', 'vector.selected'), k % 3 + 1)
        else 'state.update' end"""
    )
    e = e.withColumn("event_type", kind).withColumn("value", F.coalesce("value", F.lit(0.0)))
    payload = F.expr(
        """case event_type
        when 'session.started' then to_json(named_struct('behavior_name', concat('b', k)))
        when 'checkpoint.created' then to_json(named_struct('checkpoint_id', concat('cp', k)))
        when 'llm.request' then to_json(named_struct('request_id', concat(user_id, '-', k % 10), 'model', concat('m', k % 3),
          'messages', slice(array(named_struct('role', 'system', 'content', concat('s', k)), named_struct('role', 'user', 'content', if(k % 7 = 0, '', concat('q', k)))), 1, k % 3)))
        when 'llm.response' then to_json(named_struct('request_id', concat(user_id, '-', k % 10), 'content', if(k % 4 = 0, null, concat('r', k)),
          'tool_calls', if(k % 5 = 0, array(named_struct('id', concat('t', k))), null), 'usage', if(k % 9 = 0, null, named_struct('total_tokens', k))))
        when 'datapoint.added' then to_json(named_struct('datapoint_id', concat('d', k % 20)))
        when 'datapoint.removed' then to_json(named_struct('datapoint_id', concat('d', k % 20)))
        when 'vector.created' then to_json(named_struct('vector_id', concat('v', k % 20), 'layer', k % 8))
        when 'optimization.completed' then to_json(named_struct('sample_idx', k % 4, 'layer', k % 8, 'final_loss', round(value, 2), 'success', k % 2 = 0))
        when 'evaluation.completed' then to_json(named_struct('evaluation_id', concat('e', k), 'scores', named_struct('overall', round(value / 100, 4), 'behavior', k % 11 / 10D, 'coherence', k % 13 / 10D), 'verdict', if(k % 4 = 1, 'accepted', null)))
        when 'vector.selected' then to_json(named_struct('layer', k % 8, 'strength', cast(1.0 as double), 'score', round(value / 100, 4)))
        else '{}' end"""
    )
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "sequence",
        F.substring_index("event_type", ".", 1).alias("category"),
        "event_type",
        F.concat(F.lit("source"), F.col("k") % 3).alias("source"),
        payload.alias("payload"),
    )


#: DuckDB common tables, each after those it uses.
DUCK = {
    "candidate_vectors": """select vec_id as sample_idx, embedding::double[] as vector, 7 + 3 * (label % 3) as layer,
  (['auto', 'sweep', 'middle', 'late'])[label % 4 + 1] as layer_strategy, ((vec_id * 7) % 101) / 100.0::double as overall_score,
  vec_id % 13 <> 0 as is_valid, vec_id as pos, label from embeddings""",
    "activations": """select vec_id // 2 as pair_id, case when vec_id % 2 = 0 then 'dst' else 'src' end as side, (vec_id // 2) % 8 as sample_idx,
  14 as layer, embedding::double[] as vector from embeddings""",
    "near_dup_vectors": """select vec_id, embedding::double[] as vector from embeddings union all
  select vec_id + 1000000, list_transform(embedding::double[], lambda x, i: case when i = 1 then x + 0.01::double else x end) from embeddings where vec_id % 10 = 0""",
    "seeds": """select doc_id as pos, 'seed' || doc_id as seed_id, source as scenario, lang || (doc_id % 50) as context,
  case when doc_id % 17 = 0 then []::varchar[] when doc_id % 3 = 0 then ['c' || (doc_id % 6), 'c' || (doc_id % 4)] else ['c' || (doc_id % 6)] end as target_components,
  ((doc_id * 11) % 101) / 10.0::double as quality_score, lang as domain, (['casual', 'neutral', 'formal'])[doc_id % 3 + 1] as formality from documents""",
    "pairs": """select e.doc_id // 2 as pair_id, case when (e.doc_id // 2) % 4 = 0 then -1 else (e.doc_id // 2) % 16 end as sample_idx, e.source as prompt,
  e.text as dst, o.text as src, e.source as scenario, e.lang || (e.doc_id % 50) as context,
  (['extreme', 'high', 'medium', 'natural', null])[(e.doc_id // 2) % 5 + 1] as intensity, 1 + (e.doc_id // 2) % 3 as attempts
  from documents e join documents o on o.doc_id = e.doc_id + 1 where e.doc_id % 2 = 0""",
    "pair_scores": f"""select *, dimension >= 5 and pair_id % 11 <> 0 as is_valid, greatest(dimension, structural) as contrast_quality from
  (select *, {_SCORES} from (select *, pair_id as id from pairs))""",
    "pair_vectors": """select id as pair_id, case when id % 97 = 0 then list_transform(a.embedding::double[], lambda x: 0::double) else a.embedding::double[] end as dst_vec,
  b.embedding::double[] as src_vec from (select doc_id // 2 as id, (select count(*) from embeddings) as n from documents where doc_id % 2 = 1)
  join embeddings a on a.vec_id = id % n join embeddings b on b.vec_id = (id * 3 + 1) % n""",
    "training_metrics": """select doc_id as datapoint_id, list_transform(range(1, doc_id % 5 + 1), lambda k: ((doc_id * k) % 97) / 97.0::double) as loss_history,
  ((doc_id * 3) % 41 - 20) / 20.0::double as alignment from labels""",
    "quality_rows": """select doc_id as datapoint_id, case when doc_id % 3 = 0 then null else ((doc_id * 5) % 21 - 10) / 20.0::double end as influence,
  ((doc_id * 3) % 41 - 20) / 20.0::double as alignment, quality = 1 as steered_matches, toxic = 1 as is_outlier from labels""",
    "judgements": """select vec_id as sample_idx, item_id, (s + 1) / 2.0::double as strength, g as generation_index,
  ((vec_id * 31 + item_id * 17 + s * 7 + g * 3) % 101) / 10.0::double as score, (['behavior', 'specificity', 'coherence', 'generalization'])[item_id % 4 + 1] as dimension
  from (select vec_id, (vec_id * 31 + j) % n as item_id from embeddings, (select count(*) as n from benchmark), range(0, 4) x(j)), range(0, 5) a(s), range(0, 3) b(g)""",
    "raw_events": """select event_id, user_id, ts, event_type as kind, coalesce(value, 0) as value, (props->>'$.k')::int as k,
  row_number() over (partition by user_id order by ts, event_id) as sequence from events""",
    "event_log": """select event_id::varchar as event_id, user_id::varchar as session_id, ts as timestamp, sequence, k, value, user_id || '-' || (k % 10) as request_id, 'source' || (k % 3) as source,
  case kind when 'signup' then case when k % 2 = 0 then 'session.started' else 'checkpoint.created' end when 'click' then 'llm.request' when 'view' then 'llm.response'
  when 'purchase' then (['datapoint.added', 'datapoint.removed', 'vector.created'])[k % 3 + 1] when 'error' then (['optimization.completed', 'evaluation.completed', 'vector.selected'])[k % 3 + 1]
  else 'state.update' end as event_type from raw_events""",
}
_NEEDS = {"pair_scores": ["pairs"], "event_log": ["raw_events"]}


def sql(body: str, *names: str) -> str:
    """A DuckDB query over the named fixtures; body may start with further common tables (`name as (..), .. select`)."""
    order: list[str] = []
    for name in names:
        order += [x for x in (*_NEEDS.get(name, ()), name) if x not in order]
    head = ",\n".join(f"{n} as ({DUCK[n]})" for n in order)
    body = body.strip()
    return f"with {head}{',' if not body.lower().startswith('select') else ''}\n{body}"


def aux_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second log of the same rows: pairs, datapoint quality, tools and seed assignments."""
    e = event_log(spark, sf_dir).withColumn("k", F.substring("source", 7, 9).cast("int"))
    raw = read(spark, sf_dir, "events").selectExpr("cast(event_id as string) as event_id", "event_type as kind", "coalesce(value, 0) as value", "cast(get_json_object(props, '$.k') as int) as k", "cast(user_id as string) as u")
    e = e.drop("k", "event_type", "payload", "category").join(raw, "event_id")
    kind = F.expr(
        """case kind when 'click' then 'contrast.pair_generated' when 'view' then 'contrast.pair_validated' when 'error' then 'datapoint.quality' when 'signup' then 'seed.assigned'
        else case k % 4 when 0 then 'datapoint.added' when 1 then 'datapoint.removed' when 2 then 'tool.call' else 'tool.result' end end"""
    )
    payload = F.expr(
        """case event_type when 'contrast.pair_generated' then to_json(named_struct('pair_id', concat(u, '-', k % 10)))
        when 'contrast.pair_validated' then to_json(named_struct('pair_id', concat(u, '-', k % 10), 'is_valid', k % 2 = 0, 'contrast_quality', round(value / 10, 4)))
        when 'datapoint.quality' then to_json(named_struct('datapoint_id', concat('d', k % 4), 'recommendation', if(k % 2 = 0, 'KEEP', 'REVIEW')))
        when 'seed.assigned' then to_json(named_struct('sample_idx', k % 4, 'num_core_seeds', k, 'num_unique_seeds', k % 7))
        when 'datapoint.added' then to_json(named_struct('datapoint_id', concat('d', k div 4 % 4))) when 'datapoint.removed' then to_json(named_struct('datapoint_id', concat('d', k div 4 % 4)))
        else to_json(named_struct('call_id', concat(u, '/', k div 4 % 3), 'tool_name', concat('t', k % 5), 'success', value < 50)) end"""
    )
    e = e.withColumn("event_type", kind).withColumn("payload", payload).withColumn("category", F.substring_index("event_type", ".", 1))
    return e.select("event_id", "session_id", "timestamp", "sequence", "category", "event_type", "source", "payload")


DUCK["aux_log"] = """select user_id::varchar as session_id, ts as timestamp, sequence, k, value, user_id || '-' || (k % 10) as pair_id, 'd' || (k % 4) as quality_id, 'd' || (k // 4 % 4) as point_id, user_id || '/' || (k // 4 % 3) as call_id,
  case kind when 'click' then 'contrast.pair_generated' when 'view' then 'contrast.pair_validated' when 'error' then 'datapoint.quality' when 'signup' then 'seed.assigned'
  else (['datapoint.added', 'datapoint.removed', 'tool.call', 'tool.result'])[k % 4 + 1] end as event_type from raw_events"""
_NEEDS["aux_log"] = ["raw_events"]


def session_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user of the events table, as metadata files hold it."""
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("event_count"))
    stamp = lambda c: F.date_format(F.date_trunc("second", c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("b"), F.col("user_id") % 7).alias("behavior"),
        F.element_at(F.array(F.lit("running"), F.lit("completed"), F.lit("failed")), (F.col("user_id") % 3 + 1).cast("int")).alias("status"),
        F.when(F.col("user_id") % 10 != 0, stamp(F.col("a"))).alias("created_at"),
        F.when(F.col("user_id") % 3 != 0, stamp(F.col("b"))).alias("completed_at"),
        (F.col("user_id") % 11 / 10.0).alias("final_score"),
        "event_count",
        (F.col("user_id") % 9 == 0).alias("hidden"),
    )


DUCK["session_metadata"] = """select user_id::varchar as session_id, 'b' || (user_id % 7) as behavior, (['running', 'completed', 'failed'])[user_id % 3 + 1] as status,
  case when user_id % 10 <> 0 then strftime(date_trunc('second', min(ts)), '%Y-%m-%dT%H:%M:%SZ') end as created_at, case when user_id % 3 <> 0 then strftime(date_trunc('second', max(ts)), '%Y-%m-%dT%H:%M:%SZ') end as completed_at,
  date_trunc('second', min(ts)) as a, date_trunc('second', max(ts)) as b, (user_id % 11) / 10.0 as final_score, count(*) as event_count, user_id % 9 = 0 as hidden, user_id from events group by user_id"""
