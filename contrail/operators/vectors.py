"""Reducing groups of vectors to one: means, weighted means, principal components, contrast differences, leaderboards."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.functions.vectors import as_doubles, cosine, dot, minus, norm, scale_to_norm, unit
from contrail.operators.components import leading_components
from contrail.operators.pairs import with_rank, with_running_sum

STRATEGIES = ("best_single", "top_k_average", "weighted_average", "pca_principal", "strategy_grouped")


def mean_vector(df: DataFrame, group: list[str], vector: str = "vector", normalize: bool = True) -> DataFrame:
    """group columns, n, vector: element-wise mean, at unit norm unless zero; a single vector comes back unchanged.

    Partial sums are combined before the shuffle; vectors of unequal length in a group fail.
    """
    mean = vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col(vector)))))
    out = df.groupBy(*group).agg(F.count("*").alias("n"), mean.alias("vector"))
    return out.withColumn("vector", F.when((F.col("n") > 1) & F.lit(normalize), unit(F.col("vector"))).otherwise(F.col("vector")))


def weighted_mean_vector(df: DataFrame, group: list[str], weight: str, vector: str = "vector", normalize_weights: bool = True) -> DataFrame:
    """group columns, n, vector: sum of weight * vector, at unit norm unless zero; weights may be divided by their sum before."""
    # the sign of the sum of weights is all that dividing by it changes after normalising
    weighed = df.withColumn("_w", F.col(weight).cast("double"))
    parts = weighed.withColumn("_scaled", F.transform(as_doubles(F.col(vector)), lambda x: x * F.col("_w")))
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("_scaled"))))
    out = parts.groupBy(*group).agg(F.count("*").alias("n"), total.alias("vector"), F.sum("_w").alias("_total"))
    if normalize_weights:
        out = out.withColumn("vector", F.when(F.col("_total") != 0, F.transform("vector", lambda x: x / F.col("_total"))).otherwise(F.col("vector")))
    return out.select(*group, "n", unit(F.col("vector")).alias("vector"))


def quality_weighted_vector(df: DataFrame, group: list[str], quality: str, vector: str = "vector") -> DataFrame:
    """Weights are qualities over their sum; if that is 0, all equal."""
    sums = df.groupBy(*group).agg(F.sum(quality).alias("_q"), F.count("*").alias("_n"))
    weight = F.when(F.col("_q") == 0, 1.0 / F.col("_n")).otherwise(F.col(quality) / F.col("_q"))
    return weighted_mean_vector(df.join(sums, group).withColumn("_weight", weight), group, "_weight", vector)


#: Widest vectors whose covariance matrix is formed (8 MB), and components found of wider ones unless asked otherwise.
DENSE, WIDE = 1024, 16


def _width(df: DataFrame, vector: str) -> int:
    return df.select(F.size(vector)).first()[0]


def pca_vector(df: DataFrame, vector: str = "vector", orient: bool = True) -> DataFrame:
    """One row: n, vector, the first principal component of all rows at unit norm, turned towards their mean if orient, else
    so that its largest element is positive; one row alone comes back as it is. Up to DENSE dimensions the covariance is summed on the executors and its matrix
    reaches the driver; wider vectors go by leading_components, whose memory is a few vectors."""
    rows = df.select(array_to_vector(as_doubles(F.col(vector))).alias("x"))
    n = rows.limit(2).count()
    if n < 2:
        return df.select(F.lit(1).cast("long").alias("n"), as_doubles(F.col(vector)).alias("vector"))
    if _width(df, vector) > DENSE:
        pc = leading_components(df.select(as_doubles(F.col(vector)).alias("v")), 1).vectors
    else:
        pc = PCA(k=1, inputCol="x", outputCol="y").fit(rows).pc.toArray()
    first = [float(x) for x in pc[:, 0]]
    if max(first, key=abs) < 0:
        first = [-x for x in first]
    out = rows.agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("x"))).alias("mean"))
    first = F.lit(first)
    if orient:
        first = F.when(dot(first, F.col("mean")) < 0, F.transform(first, lambda x: -x)).otherwise(first)
    return out.select("n", first.alias("vector"))


def weighted_pca_vector(df: DataFrame, weight: str, vector: str = "vector") -> DataFrame:
    """pca_vector of the rows times the root of their share of all weights, centred by their plain mean."""
    total = df.agg(F.sum(weight)).first()[0] or 1.0
    share = F.sqrt(F.col(weight) / F.lit(float(total)))
    return pca_vector(df.select(F.transform(as_doubles(F.col(vector)), lambda x: x * share).alias("vector")), "vector", orient=False)


def variance_explained(df: DataFrame, vector: str = "vector", k: int | None = None) -> DataFrame:
    """component (from 0), share of variance; fewer than two rows: one component with all of it. All components by default; of vectors wider than DENSE the leading WIDE."""
    rows = df.select(array_to_vector(as_doubles(F.col(vector))).alias("x"))
    n = rows.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([(0, 1.0)], "component int, share double")
    d = _width(df, vector)
    if d > DENSE:
        shares = leading_components(df.select(as_doubles(F.col(vector)).alias("v")), min(k or WIDE, n, d)).shares
        return rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(shares)], "component int, share double")
    model = PCA(k=min(k or n, n, d), inputCol="x", outputCol="y").fit(rows)
    return rows.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(model.explainedVariance.toArray())], "component int, share double")


def contrastive_vector(activations: DataFrame, group: list[str], outlier_std: float | None = 3.0, target_norm: float = 1.0) -> DataFrame:
    """group columns, n, vector: mean of dst minus src activation over pairs, at `target_norm` unless zero.

    Pairs without both sides are left out; with outlier_std, those whose distance from the mean exceeds the mean distance by so
    many population standard deviations are too.
    """
    side = lambda s: activations.where(F.col("side") == s).select(*group, "pair_id", as_doubles(F.col("vector")).alias(s))
    diff = side("dst").join(side("src"), [*group, "pair_id"]).select(*group, "pair_id", minus(F.col("dst"), F.col("src")).alias("vector"))
    if outlier_std is not None:
        centre = mean_vector(diff, group, normalize=False).select(*group, F.col("vector").alias("_centre"))
        far = diff.join(centre, group).withColumn("_far", norm(minus(F.col("vector"), F.col("_centre"))))
        limit = far.groupBy(*group).agg((F.avg("_far") + outlier_std * F.stddev_pop("_far")).alias("_limit"))
        diff = far.join(limit, group).where("_far <= _limit").select(*group, "pair_id", "vector")
    out = mean_vector(diff, group, normalize=False)
    return out.withColumn("vector", scale_to_norm(F.col("vector"), target_norm))


def rank_samples(df: DataFrame, score: str = "overall_score", group: list[str] | None = None) -> DataFrame:
    """Valid rows with rank from 1, best score first, earlier pos first on ties. Without groups rows are ranked by ranges, which are
    written when this is called; in groups by a window, which a `rank <= k` behind it cuts before the shuffle."""
    if not group:
        order = F.struct(F.col(score).isNull().alias("none"), (~F.isnan(score)).alias("number"), (-F.col(score)).alias("down"), "pos")
        return with_rank(df.where("is_valid"), (), order)
    w = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), F.col("pos"))
    return df.where("is_valid").withColumn("rank", F.row_number().over(w))


def top_samples(df: DataFrame, k: int, score: str = "overall_score") -> DataFrame:
    """The k best valid rows with rank; a bounded top-k, so that no full sort meets in one task."""
    order = (F.col(score).desc_nulls_last(), F.col("pos"))
    best = df.where("is_valid").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # k rows


def grouped_vector(df: DataFrame, k: int, group: str = "layer_strategy", score: str = "overall_score") -> DataFrame:
    """One row: vector, score, layer. The k best rows give a unit mean per group, those a mean weighted by the groups' mean
    scores, at unit norm; score is the mean of group scores, layer that of the best row."""
    best = top_samples(df, k, score)
    groups = mean_vector(best, [group]).join(best.groupBy(group).agg(F.avg(score).alias("_score")), group).withColumn("_all", F.lit(0))
    out = weighted_mean_vector(groups, ["_all"], "_score").select("vector")
    top = best.where("rank = 1").select("layer")
    return out.crossJoin(groups.agg(F.avg("_score").alias("score"))).crossJoin(top)  # one row each


def aggregate_vectors(df: DataFrame, strategy: str, k: int = 5, score: str = "overall_score") -> DataFrame:
    """One row: vector, score, layer, n of the k best valid rows (all if fewer) by the strategy; no valid row fails."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    best = top_samples(df, 1 if strategy == "best_single" else k, score)
    if best.isEmpty():
        raise ValueError("no valid vector to aggregate")
    facts = best.agg(F.avg(score).alias("score"), F.min_by("layer", "rank").alias("layer"), F.count("*").alias("n"))
    one = best.withColumn("_all", F.lit(0))
    if strategy == "best_single":
        vector = best.select(as_doubles(F.col("vector")).alias("vector"))
    elif strategy == "top_k_average":
        vector = mean_vector(one, ["_all"]).select("vector")
    elif strategy == "weighted_average":
        vector = quality_weighted_vector(one, ["_all"], score).select("vector")
    elif strategy == "pca_principal":
        vector = pca_vector(best).select("vector")
    else:
        grouped = grouped_vector(df, k, score=score)
        return grouped.crossJoin(best.agg(F.count("*").alias("n"))).select("vector", "score", "layer", "n")
    return vector.crossJoin(facts).select("vector", "score", "layer", "n")


def pool_tokens(tokens: DataFrame, position: str = "mean") -> DataFrame:
    """response_id, vector of tokens(response_id, token_pos, part, vector): the response tokens' mean, their last, or the prompt's last."""
    if position == "mean":
        return mean_vector(tokens.where("part = 'response'"), ["response_id"], normalize=False).select("response_id", "vector")
    part = "response" if position == "last_token" else "prompt"
    return tokens.where(F.col("part") == part).groupBy("response_id").agg(F.max_by(as_doubles(F.col("vector")), F.col("token_pos")).alias("vector"))


def detect_behavior(activations: DataFrame, vector: DataFrame, threshold: float) -> DataFrame:
    """activations with score, the cosine to the one vector, and detected."""
    one = vector.select(as_doubles(F.col("vector")).alias("_v")).limit(1)
    out = activations.crossJoin(F.broadcast(one)).withColumn("score", cosine(as_doubles(F.col("vector")), F.col("_v")))
    return out.drop("_v").withColumn("detected", F.col("score") > threshold)


def auroc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """One row: auroc, n. Ranks of equal scores are averaged; scores are counted first, and those below one are summed by ranges, which are
    written when this is called."""
    counts = df.groupBy(score).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    ranked = with_running_sum(counts, score, F.col("neg"), "below")
    sums = ranked.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return sums.select((F.col("wins") / (F.col("p") * F.col("q"))).alias("auroc"), (F.col("p") + F.col("q")).alias("n"))


def pairwise_similarity(df: DataFrame, key: str, vector: str = "vector", most: int = 2000) -> DataFrame:
    """left, right, similarity of all pairs of a selection; a larger table than `most` fails, see near_duplicates for that."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a selection of at most {most} vectors is compared pair by pair")
    a = df.select(F.col(key).alias("left"), as_doubles(F.col(vector)).alias("_a"))
    b = df.select(F.col(key).alias("right"), as_doubles(F.col(vector)).alias("_b"))
    return a.join(F.broadcast(b), F.col("left") < F.col("right")).select("left", "right", cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def best_layer(vectors: DataFrame, optimizations: DataFrame, success_only: bool = True) -> DataFrame:
    """vectors with score: the least final_loss of its layer, null if none; is_best marks the layer with the least, earliest on ties."""
    runs = optimizations.where("final_loss is not null")
    if success_only:
        runs = runs.where("success")
    layers = runs.groupBy("layer").agg(F.min("final_loss").alias("score"), F.min("pos").alias("_first"))
    top = layers.agg(F.min_by("layer", F.struct("score", "_first")).alias("_best"))
    return vectors.join(layers.drop("_first"), "layer", "left").crossJoin(F.broadcast(top)).withColumn("is_best", F.col("layer").eqNullSafe(F.col("_best"))).drop("_best")


