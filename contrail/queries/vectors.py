"""Queries on vectors: functions, reductions, near duplicates, diversity, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.fixtures import activations, candidate_vectors, near_dup_vectors, pair_vectors, read, sql
from contrail.functions.vectors import cosine, dot, minus, norm, scale_to_norm, unit
from contrail.operators import diversity as d
from contrail.operators import vectors as v


def exploded(df: DataFrame, *keys: str, vector: str = "vector") -> DataFrame:
    """One row per element, rounded to 6 places."""
    return df.select(*keys, F.posexplode(vector).alias("dim", "x")).select(*keys, "dim", F.round("x", 6).alias("x"))


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


def entry_query(spark, d_):
    """Rank, top 5 per label, score-weighted unit vector per label."""
    best = v.rank_samples(candidate_vectors(spark, d_), group=["label"]).where("rank <= 5")
    return exploded(v.weighted_mean_vector(best, ["label"], "overall_score"), "label")


def _functions(spark, d_):
    p = pair_vectors(spark, d_)
    a, b = F.col("dst_vec"), F.col("src_vec")
    out = p.select("pair_id", dot(a, b).alias("dot"), norm(a).alias("norm"), norm(unit(b)).alias("unit_norm"), norm(scale_to_norm(a, 3.0)).alias("scaled_norm"), cosine(a, b).alias("cosine"))
    return rounded(out, "dot", "norm", "unit_norm", "scaled_norm", "cosine")


def _labelled(spark, d_):
    vectors = candidate_vectors(spark, d_)
    centre = v.mean_vector(vectors.where("label = 0"), ["label"], normalize=False).select("vector")
    return vectors, centre


def _detect(spark, d_):
    vectors, centre = _labelled(spark, d_)
    return rounded(v.detect_behavior(vectors, centre, 0.1).select("sample_idx", "score", "detected"), "score")


def _auroc(spark, d_):
    vectors, centre = _labelled(spark, d_)
    scored = v.detect_behavior(vectors, centre, 0.1).withColumn("score", F.round("score", 6)).withColumn("truth", F.col("label") == 0)
    return rounded(v.auroc(scored, "score", "truth"), "auroc")


def _tokens(spark, d_):
    return candidate_vectors(spark, d_).selectExpr("sample_idx div 4 as response_id", "sample_idx % 4 as token_pos", "if(sample_idx % 4 = 0, 'prompt', 'response') as part", "vector")


def _best_layer(spark, d_):
    vectors = candidate_vectors(spark, d_).select("layer").distinct()
    runs = candidate_vectors(spark, d_).select("layer", F.when(F.col("pos") % 5 != 0, F.col("overall_score")).alias("final_loss"), (F.col("pos") % 2 == 0).alias("success"), "pos")
    return v.best_layer(vectors, runs)


def _aggregate(strategy):
    return lambda spark, d_: exploded(rounded(v.aggregate_vectors(candidate_vectors(spark, d_), strategy, 16), "score"), "score", "layer", "n")


def _diversity(spark, d_):
    docs = read(spark, d_, "documents").select(F.col("doc_id").alias("sample_idx"), d.words_of(F.col("text")).alias("words"))  # counted before the join, which moves no text
    rows = candidate_vectors(spark, d_).join(docs, "sample_idx")
    out = d.is_diverse_enough(d.diversity_metrics(rows, "sample_idx", "label", words="words"), 0.02, 0.5)
    return rounded(out, "avg_similarity", "min_distance", "word_std")


def _clusters(spark, d_):
    """One row: rows, clusters, and whether clusters are tighter than the table."""
    rows = d.cluster_vectors(candidate_vectors(spark, d_)).select("cluster", "vector").withColumn("all", F.lit(0))
    spread = lambda by: rows.join(v.mean_vector(rows, [by], normalize=False).select(by, F.col("vector").alias("c")), by).agg(F.sum(norm(minus(F.col("vector"), F.col("c")))).alias(f"spread_{by}"))
    sizes = rows.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"))
    return sizes.crossJoin(spread("cluster")).crossJoin(spread("all")).select("n", "clusters", (F.col("spread_cluster") < F.col("spread_all")).alias("tighter"))  # one row each


#: Picks of the greedy choice over the whole table: a report of its best rows.
PICKS = 30

QUERIES = {
    "e1_d16_top_weighted_vector": entry_query,
    "g11_vector_functions": _functions,
    "b3_semantic_distance": lambda s, p: _semantic(s, p),
    "d15_mean_vector": lambda s, p: exploded(v.mean_vector(candidate_vectors(s, p), ["layer_strategy"]), "layer_strategy"),
    "d16_weighted_mean_vector": lambda s, p: exploded(v.weighted_mean_vector(candidate_vectors(s, p), ["layer"], "overall_score"), "layer"),
    "d17_quality_weighted_vector": lambda s, p: exploded(v.quality_weighted_vector(candidate_vectors(s, p), ["label"], "overall_score"), "label"),
    "d18_pca_vector": lambda s, p: exploded(v.pca_vector(candidate_vectors(s, p))),
    "d19_weighted_pca_vector": lambda s, p: exploded(v.weighted_pca_vector(candidate_vectors(s, p), "overall_score")),
    "d20_variance_explained": lambda s, p: rounded(v.variance_explained(candidate_vectors(s, p)), "share"),
    "d20_first_share": lambda s, p: rounded(v.variance_explained(candidate_vectors(s, p)).where("component = 0"), "share"),
    "d2_cluster_check": _clusters,
    "d21_grouped_vector": lambda s, p: exploded(rounded(v.grouped_vector(candidate_vectors(s, p), 16), "score"), "score", "layer"),
    **{f"d22_aggregate_{x}": _aggregate(x) for x in v.STRATEGIES},
    "d23_contrastive_vector": lambda s, p: exploded(v.contrastive_vector(activations(s, p), ["sample_idx", "layer"], 1.5), "sample_idx", "layer", "n"),
    "g12_pool_tokens": lambda s, p: exploded(v.pool_tokens(_tokens(s, p)), "response_id"),
    "g12_pool_last_token": lambda s, p: exploded(v.pool_tokens(_tokens(s, p), "last_token"), "response_id"),
    "g13_detect_behavior": _detect,
    "g13_auroc": _auroc,
    "c5_near_duplicates": lambda s, p: rounded(d.near_duplicates(near_dup_vectors(s, p), "vec_id", 0.4), "similarity"),
    "c5_near_duplicates_lsh": lambda s, p: rounded(d.near_duplicates_lsh(near_dup_vectors(s, p), "vec_id", 0.9), "similarity"),
    "c7_best_layer": _best_layer,
    "c8_pairwise_similarity": lambda s, p: rounded(v.pairwise_similarity(v.top_samples(candidate_vectors(s, p), 40), "sample_idx"), "similarity"),
    "d1_d4_diversity_metrics": _diversity,
    "d2_cluster_vectors": lambda s, p: d.cluster_vectors(candidate_vectors(s, p)).select("sample_idx", "cluster"),
    "d3_cluster_balance": lambda s, p: rounded(d.cluster_balance(candidate_vectors(s, p), "label", ["layer_strategy"]), "balance"),
    "e1_rank_samples": lambda s, p: v.rank_samples(candidate_vectors(s, p)).select("sample_idx", "layer", "overall_score", "rank"),
    "e7_mmr_select": lambda s, p: d.mmr_select(candidate_vectors(s, p), 3, ["label"], "overall_score").select("label", "sample_idx", "rank"),
    "e7_mmr_select_global": lambda s, p: d.mmr_select_global(candidate_vectors(s, p), PICKS, "overall_score"),
    "e12_detect_outliers": lambda s, p: rounded(d.detect_outliers(candidate_vectors(s, p)).select("sample_idx", "distance", "is_outlier"), "distance"),
}


def _semantic(spark, p):
    from contrail.operators.pairs import semantic_distance

    out = semantic_distance(pair_vectors(spark, p), "dst_vec", "src_vec", 0.9).select("pair_id", "distance", "semantic_score", "semantic_valid")
    return rounded(out, "distance", "semantic_score")




def _unit_of(groups: str, table: str, weight: str = "1.0::double", where: str = "true", normalise: str = "true") -> str:
    """Common tables: parts (weighted sums per element) and units."""
    keys = groups or "0"
    return f"""parts as (select {keys} as g, i, sum(vector[i] * {weight}) as s from {table}, range(1, 65) t(i) where {where} group by all),
norms as (select g, sqrt(sum(s * s)) as n from parts group by g)"""


_MEAN = "select g as {key}, i - 1 as dim, round(case when n > 0 then s / n else s end, 6) as x from parts join norms using (g)"
_TOP = "top as (select *, row_number() over (order by overall_score desc, pos) as rank from candidate_vectors where is_valid qualify rank <= 16), facts as (select round(avg(overall_score), 6) as score, min_by(layer, rank) as layer, count(*) as n from top)"
_AGG = "select score, layer, f.n, i - 1 as dim, round(case when norms.n > 0 then s / norms.n else s end, 6) as x from parts join norms using (g), facts f"
_CENTRE = "centre as (select list(m order by i) as c from (select i, avg(vector[i]) as m from candidate_vectors, range(1, 65) t(i) where label = 0 group by i)), scored as (select sample_idx, label, round(list_inner_product(vector, c) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(c, c))), 6) as score from candidate_vectors, centre)"
_UNITS = "units as (select *, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) as u from candidate_vectors)"
_TOKENS = "tokens as (select sample_idx // 4 as response_id, sample_idx % 4 as token_pos, case when sample_idx % 4 = 0 then 'prompt' else 'response' end as part, vector from candidate_vectors)"

SQUARINGS = 14


def _axis(rows: str) -> str:
    """Common tables: axis(i, v), the first principal axis of rows(v), and share(s), its part of the variance: the covariance over its
    trace, squared until only the largest eigenvalue counts."""
    out = [
        f"rows as materialized ({rows})",
        "ctr as materialized (select i, avg(v[i]) as m from rows, range(1, 65) t(i) group by i)",
        "flat as materialized (select r, i, v[i] - m as x from (select row_number() over () as r, v from rows), ctr)",
        "cov as materialized (select a.i, b.i as j, sum(a.x * b.x) as x from flat a join flat b using (r) group by all)",
        "m0 as materialized (select i, j, x / (select sum(x) from cov where i = j) as x from cov)",
    ]
    for k in range(SQUARINGS):
        out.append(f"p{k} as materialized (select a.i, b.j, sum(a.x * b.x) as x from m{k} a join m{k} b on a.j = b.i group by all)")
        out.append(f"m{k + 1} as materialized (select i, j, x / (select sum(x) from p{k} where i = j) as x from p{k})")
    last = f"m{SQUARINGS}"
    out.append(f"big as materialized (select j, x from {last} where i = j order by x desc limit 1)")
    out.append(f"raw as materialized (select {last}.i, {last}.x / sqrt(big.x) as v from {last} join big using (j))")
    out.append("axis as materialized (select i, v * (select sign(first(v order by abs(v) desc)) from raw) as v from raw)")
    out.append("share as materialized (select sum(a.v * b.v * m0.x) as s from m0 join axis a on a.i = m0.i join axis b on b.i = m0.j)")
    return ", ".join(out)


_TO_MEAN = "i - 1 as dim, round(v * case when (select sum(v * m) from axis join ctr using (i)) < 0 then -1 else 1 end, 6) as x from axis"

def _greedy_sql(n: int) -> str:
    """Plain greedy choice, a common table for each pick."""
    out = """, near1 as materialized (select pos, overall_score as r, u, null::double as near from units), pick1 as materialized (select pos, u from near1 order by r desc, pos limit 1)"""
    for i in range(2, n + 1):
        out += f""", near{i} as materialized (select x.pos, r, x.u, greatest(near, list_inner_product(x.u, p.u)) as near from near{i - 1} x, pick{i - 1} p where x.pos <> p.pos),
        pick{i} as materialized (select pos, u from near{i} order by 0.5 * r - 0.5 * near desc, pos limit 1)"""
    return out + "\n" + " union all ".join(f"select pos, {i} as rank from pick{i}" for i in range(1, n + 1))


ORACLE = {
    "d18_pca_vector": sql(_axis("select vector as v from candidate_vectors") + " select " + _TO_MEAN, "candidate_vectors"),
    "d19_weighted_pca_vector": sql(_axis("select list_transform(vector, lambda x: x * f) as v from (select vector, sqrt(overall_score / sum(overall_score) over ()) as f from candidate_vectors)") + " select i - 1 as dim, round(v, 6) as x from axis", "candidate_vectors"),
    "d20_first_share": sql(_axis("select vector as v from candidate_vectors") + " select 0 as component, round(s, 6) as share from share", "candidate_vectors"),
    "d22_aggregate_pca_principal": sql(_TOP + ", " + _axis("select vector as v from top") + " select score, layer, n, " + _TO_MEAN + ", facts", "candidate_vectors"),
    "d2_cluster_check": "select count(*) as n, 5 as clusters, true as tighter from embeddings",
    "e7_mmr_select": sql(
        _UNITS + """, one as (select label, sample_idx, pos, u from units qualify row_number() over (partition by label order by overall_score desc, pos) = 1),
        two as (select b.label, b.sample_idx, b.pos, b.u, one.pos as p1, one.u as u1 from units b join one using (label) where b.pos <> one.pos qualify row_number() over (partition by label order by 0.5 * b.overall_score - 0.5 * list_inner_product(one.u, b.u) desc, b.pos) = 1),
        three as (select b.label, b.sample_idx from units b join two using (label) where b.pos not in (two.pos, two.p1) qualify row_number() over (partition by label order by 0.5 * b.overall_score - 0.5 * greatest(list_inner_product(two.u, b.u), list_inner_product(two.u1, b.u)) desc, b.pos) = 1)
        select label, sample_idx, 1 as rank from one union all select label, sample_idx, 2 from two union all select label, sample_idx, 3 from three""",
        "candidate_vectors",
    ),
    "e1_d16_top_weighted_vector": sql(
        "best as (select * from candidate_vectors where is_valid qualify row_number() over (partition by label order by overall_score desc, pos) <= 5), " + _unit_of("label", "best", "overall_score") + " " + _MEAN.format(key="label"), "candidate_vectors"
    ),
    "g11_vector_functions": sql(
        """select pair_id, round(list_inner_product(dst_vec, src_vec), 6) as dot, round(sqrt(list_inner_product(dst_vec, dst_vec)), 6) as norm, 1.0::double as unit_norm,
        case when list_inner_product(dst_vec, dst_vec) > 0 then 3.0::double else 0.0::double end as scaled_norm,
        round(case when list_inner_product(dst_vec, dst_vec) > 0 then list_inner_product(dst_vec, src_vec) / (sqrt(list_inner_product(dst_vec, dst_vec)) * sqrt(list_inner_product(src_vec, src_vec))) else 0 end, 6) as cosine from pair_vectors""",
        "pair_vectors",
    ),
    "b3_semantic_distance": sql(
        """cos as (select pair_id, list_inner_product(dst_vec, dst_vec) as q, list_inner_product(dst_vec, src_vec) / (sqrt(list_inner_product(dst_vec, dst_vec)) * sqrt(list_inner_product(src_vec, src_vec))) as c from pair_vectors)
        select pair_id, round(case when q > 0 then 1 - c else 0 end, 6) as distance, round(case when q > 0 then least(10, (1 - c) / 0.7 * 10) else 0 end, 6) as semantic_score, q > 0 and 1 - c >= 0.9 as semantic_valid from cos""",
        "pair_vectors",
    ),
    "d15_mean_vector": sql(_unit_of("layer_strategy", "candidate_vectors") + " " + _MEAN.format(key="layer_strategy"), "candidate_vectors"),
    "d16_weighted_mean_vector": sql(_unit_of("layer", "candidate_vectors", "overall_score") + " " + _MEAN.format(key="layer"), "candidate_vectors"),
    "d17_quality_weighted_vector": sql(_unit_of("label", "candidate_vectors", "overall_score") + " " + _MEAN.format(key="label"), "candidate_vectors"),
    "d21_grouped_vector": sql(
        _TOP
        + """, means as (select layer_strategy as ls, i, avg(vector[i]) as m, count(*) as c from top, range(1, 65) t(i) group by all), lens as (select ls, sqrt(sum(m * m)) as l from means group by ls),
        gs as (select layer_strategy as ls, avg(overall_score) as sc from top group by 1), parts as (select i, sum(case when c > 1 then m / l else m end * sc) as s from means join lens using (ls) join gs using (ls) group by i), norms as (select sqrt(sum(s * s)) as n from parts)
        select round((select avg(sc) from gs), 6) as score, layer, i - 1 as dim, round(s / norms.n, 6) as x from parts, norms, facts""",
        "candidate_vectors",
    ),
    "d22_aggregate_best_single": sql(_TOP + " select round(overall_score, 6) as score, layer, 1 as n, i - 1 as dim, round(vector[i], 6) as x from top, range(1, 65) t(i) where rank = 1", "candidate_vectors"),
    "d22_aggregate_top_k_average": sql(_TOP + ", " + _unit_of("0", "top") + " " + _AGG, "candidate_vectors"),
    "d22_aggregate_weighted_average": sql(_TOP + ", " + _unit_of("0", "top", "overall_score") + " " + _AGG, "candidate_vectors"),
    "d22_aggregate_strategy_grouped": sql(
        _TOP
        + """, means as (select layer_strategy as ls, i, avg(vector[i]) as m, count(*) as c from top, range(1, 65) t(i) group by all), lens as (select ls, sqrt(sum(m * m)) as l from means group by ls),
        gs as (select layer_strategy as ls, avg(overall_score) as sc from top group by 1), parts as (select i, sum(case when c > 1 then m / l else m end * sc) as s from means join lens using (ls) join gs using (ls) group by i), norms as (select sqrt(sum(s * s)) as n from parts)
        select round((select avg(sc) from gs), 6) as score, layer, facts.n, i - 1 as dim, round(s / norms.n, 6) as x from parts, norms, facts""",
        "candidate_vectors",
    ),
    "d23_contrastive_vector": sql(
        """diff as (select a.sample_idx, a.layer, a.pair_id, list_transform(range(1, 65), lambda i: a.vector[i] - b.vector[i]) as v from activations a join activations b using (pair_id) where a.side = 'dst' and b.side = 'src'),
        centre as (select sample_idx, list(m order by i) as c from (select sample_idx, i, avg(v[i]) as m from diff, range(1, 65) t(i) group by all) group by 1),
        far as (select diff.*, sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) ** 2))) as f from diff join centre using (sample_idx)),
        lim as (select sample_idx, avg(f) + 1.5 * stddev_pop(f) as l from far group by 1), kept as (select far.* from far join lim using (sample_idx) where f <= l),
        parts as (select sample_idx, layer, i, avg(v[i]) as s, count(*) as n from kept, range(1, 65) t(i) group by all), norms as (select sample_idx, sqrt(sum(s * s)) as l from parts group by 1)
        select sample_idx, layer, n, i - 1 as dim, round(s / l, 6) as x from parts join norms using (sample_idx)""",
        "activations",
    ),
    "g12_pool_tokens": sql(_TOKENS + " select response_id, i - 1 as dim, round(avg(vector[i]), 6) as x from tokens, range(1, 65) t(i) where part = 'response' group by all", "candidate_vectors"),
    "g12_pool_last_token": sql(_TOKENS + " select response_id, i - 1 as dim, round(max_by(vector[i], token_pos), 6) as x from tokens, range(1, 65) t(i) where part = 'response' group by all", "candidate_vectors"),
    "g13_detect_behavior": sql(_CENTRE + " select sample_idx, score, score > 0.1 as detected from scored", "candidate_vectors"),
    "g13_auroc": sql(
        _CENTRE
        + """, pairs as (select p.score as x, q.score as y from scored p, scored q where p.label = 0 and q.label <> 0)
        select round(avg(case when x > y then 1.0 when x = y then 0.5 else 0 end), 6) as auroc, (select count(*) from scored) as n from pairs""",
        "candidate_vectors",
    ),
    "c5_near_duplicates": sql(
        """units as (select vec_id, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) as u from near_dup_vectors)
        select a.vec_id as "left", b.vec_id as "right", round(list_inner_product(a.u, b.u), 6) as similarity from units a join units b on a.vec_id < b.vec_id where list_inner_product(a.u, b.u) > 0.4""",
        "near_dup_vectors",
    ),
    "c5_near_duplicates_lsh": sql(
        """units as (select vec_id, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) as u from near_dup_vectors)
        select a.vec_id as "left", b.vec_id as "right", round(list_inner_product(a.u, b.u), 6) as similarity from units a join units b on a.vec_id < b.vec_id where list_inner_product(a.u, b.u) > 0.9""",
        "near_dup_vectors",
    ),
    "c7_best_layer": sql(
        """runs as (select layer, case when pos % 5 <> 0 then overall_score end as l, pos from candidate_vectors where pos % 2 = 0), best as (select layer, min(l) as score, min(pos) filter (where l is not null) as f from runs where l is not null group by layer)
        select v.layer, score, v.layer = (select layer from best order by score, f limit 1) as is_best from (select distinct layer from candidate_vectors) v left join best using (layer)""",
        "candidate_vectors",
    ),
    "c8_pairwise_similarity": sql(
        _UNITS
        + """, top as (select * from units where is_valid order by overall_score desc, pos limit 40)
        select a.sample_idx as "left", b.sample_idx as "right", round(list_inner_product(a.u, b.u), 6) as similarity from top a join top b on a.sample_idx < b.sample_idx""",
        "candidate_vectors",
    ),
    "d1_d4_diversity_metrics": sql(
        _UNITS
        + r""", rows as (select units.*, text from units join documents on doc_id = sample_idx), sims as (select a.label, list_inner_product(a.u, b.u) as c from rows a join rows b on a.label = b.label and a.sample_idx < b.sample_idx),
        m as (select label, avg(c) as a, 1 - max(c) as m from sims group by 1), w as (select label, count(*) as n, stddev_pop(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) as s from rows group by 1)
        select label, n, round(coalesce(a, 0), 6) as avg_similarity, round(coalesce(m, 1), 6) as min_distance, round(s, 6) as word_std,
        case when coalesce(a, 0) > 0.02 then 'average similarity too high' when coalesce(m, 1) < 0.5 then 'closest pair too near' else 'ok' end as reason, coalesce(a, 0) <= 0.02 and coalesce(m, 1) >= 0.5 as diverse, coalesce(a, 0) < 0.02 and coalesce(m, 1) > 0.5 as strictly_diverse from w left join m using (label)""",
        "candidate_vectors",
    ),
    "d3_cluster_balance": sql("c as (select layer_strategy, label, count(*) as c from candidate_vectors group by all) select layer_strategy, count(*) as clusters, round(greatest(0, least(1, 1 - stddev_pop(c) / avg(c))), 6) as balance from c group by 1", "candidate_vectors"),
    "e1_rank_samples": sql("select sample_idx, layer, overall_score, row_number() over (order by overall_score desc, pos) as rank from candidate_vectors where is_valid", "candidate_vectors"),
    "e7_mmr_select_global": sql(_UNITS + _greedy_sql(PICKS), "candidate_vectors"),
    "e12_detect_outliers": sql(
        """centre as (select list(m order by i) as c from (select i, avg(vector[i]) as m from candidate_vectors, range(1, 65) t(i) group by i)), far as (select sample_idx, sqrt(list_sum(list_transform(range(1, 65), lambda i: (vector[i] - c[i]) ** 2))) as f from candidate_vectors, centre)
        select sample_idx, round(f, 6) as distance, f > (select avg(f) + 2 * stddev_pop(f) from far) as is_outlier from far""",
        "candidate_vectors",
    ),
}
