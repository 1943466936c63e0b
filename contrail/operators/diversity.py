"""Diversity, near duplicates, clusters and greedy selection of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contrail.functions.vectors import as_doubles, dot, minus, norm, unit
from contrail.operators import metric_index as index
from contrail.sources.scratch import kept

def near_duplicates(df: DataFrame, key: str, threshold: float = 0.9, vector: str = "vector", blocks: int | None = None, block: int = index.BLOCK, pivots: int | None = None, lots: int | None = None) -> DataFrame:
    """left, right, similarity for left < right with cosine above the threshold; a zero vector has similarity 0. Exact.

    Rows lie in blocks of a metric index (written when this is called); only blocks whose angles to the pivots allow the threshold meet, by matrix products. Blocks that follow each
    other are sent as one lot, so what is shuffled grows with the rows until a lot is full (see Index), and from there with rows times lots; the pairs that are compared grow as
    compared_pairs tells: few for clustered vectors, all where nothing can be ruled out. Thresholds below 0 rule out nothing. Blocks have about `block` rows, or a share of the table where `blocks` asks for at least so many.
    """
    block = _rows_a_block(df, blocks, block)
    own = index.build(df.select(F.col(key).cast("long").alias("id"), vector), "id", vector, block=block, pivots=pivots, lots=lots)
    if threshold < 0:  # zero vectors, and very short ones, are nearer than their angles say
        own = index.Index(own.rows.withColumn("block", F.coalesce("block", F.lit("zero"))), own.blocks.select("g", "block", "n", "lo", "hi", "lot").unionByName(_zero_block(own)))

    def compare(blocks: dict, todo: list) -> Iterator[tuple]:
        for _, a, b, _ in todo:
            (left, x), (right, y) = blocks[a], blocks[b]
            for i, j, s in index.above(x, y, threshold, a == b):
                i, j = left[i], right[j]
                new = i != j
                yield np.minimum(i, j)[new], np.maximum(i, j)[new], s[new]

    pairs = index.block_pairs(own, float(np.arccos(min(threshold, 1.0))) if threshold >= 0 else None)
    return index.meet(own, pairs, compare, "left long, right long, similarity double").drop("g")


def _rows_a_block(df: DataFrame, blocks: int | None, block: int) -> int:
    return max(1, -(-df.count() // blocks)) if blocks else block


def _zero_block(own: index.Index) -> DataFrame:
    """The block of zero vectors, if there are any, which nothing rules out."""
    wide = own.blocks.select(F.size("lo").alias("k")).limit(1)
    zero = own.rows.where("block is null").groupBy("g").agg(F.count("*").alias("n")).crossJoin(F.broadcast(wide))  # one row
    return zero.select("g", F.lit("zero").alias("block"), "n", F.array_repeat(F.lit(0.0), F.col("k")).alias("lo"), F.array_repeat(F.lit(np.pi), F.col("k")).alias("hi"), F.lit(1 << 40).alias("lot"))  # behind the lots of blocks, as its name is


def compared_pairs(df: DataFrame, key: str, threshold: float = 0.9, vector: str = "vector", block: int = index.BLOCK, pivots: int | None = None) -> DataFrame:
    """rows, pairs (all), compared (of near_duplicates) and blocks: one row."""
    own = index.build(df, key, vector, block=block, pivots=pivots)
    met = index.block_pairs(own, float(np.arccos(min(max(threshold, 0.0), 1.0)))).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))
    whole = own.rows.agg(F.count("*").alias("rows"))
    return whole.crossJoin(F.broadcast(met)).crossJoin(F.broadcast(own.blocks.agg(F.count("*").alias("blocks")))).select("rows", F.expr("rows * (rows - 1) div 2").alias("pairs"), "compared", "blocks")


def near_duplicates_lsh(df: DataFrame, key: str, threshold: float = 0.9, vector: str = "vector", tables: int = 24, bits: int = 10, seed: int = 5, part: int = index.LOT) -> DataFrame:
    """As near_duplicates, but only pairs that share the signs of `bits` random projections in one of `tables` tables are compared. Runs when it is called.

    A row goes to its bucket of each table once, with the numbers of all its buckets; a bucket's rows meet in one task by matrix products, and a pair comes from the first table that
    it shares only. Buckets of over `part` rows are dealt to parts, each pair of which is a task."""

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy())
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(v.shape[1], tables * bits))
            signs = (v @ planes > 0).reshape(len(v), tables, bits)
            yield pdf.assign(codes=list((signs @ (1 << np.arange(bits))).astype("int32")))

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        table, same = key[0].as_py(), key[2] == key[3]
        ids, u, codes = rows["id"].to_numpy(), index.matrix(rows["v"]), index.matrix(rows["codes"])
        one = np.ones(len(ids), bool) if same else rows["p"].to_numpy() == key[2].as_py()
        for i, j, s in index.above(u[one], u if same else u[~one], threshold, same):
            i, j = np.flatnonzero(one)[i], j if same else np.flatnonzero(~one)[j]
            new = (ids[i] != ids[j]) & ~(codes[i, :table] == codes[j, :table]).any(axis=1)
            left, right = ids[i[new]], ids[j[new]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(s[new])], ["left", "right", "similarity"])

    rows = df.select(F.col(key).cast("long").alias("id"), as_doubles(F.col(vector)).alias("v"))
    rows = rows.where(norm(F.col("v")) > 0)  # a zero vector is like nothing
    hashed = kept(rows.mapInPandas(buckets, "id long, v array<double>, codes array<int>").select("id", unit(F.col("v")).alias("v"), "codes"))
    large = hashed.select(F.posexplode("codes").alias("t", "b")).groupBy("t", "b").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")  # at most tables * rows / part
    dealt = hashed.select("id", "v", "codes", F.posexplode("codes").alias("t", "b")).join(F.broadcast(kept(large)), ["t", "b"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.select("t", "b", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "id", "v", "codes").groupBy("t", "b", "lo", "hi").applyInArrow(meet, "left long, right long, similarity double")
    return met.dropDuplicates(["left", "right"])


def words_of(text: Column) -> Column:
    """Words by whitespace; null and blank texts have none. They are counted in one pass, without a copy of the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def mean_similarity(df: DataFrame, group: list[str], vector: str = "vector") -> DataFrame:
    """group columns, n, mean cosine over all pairs in one pass: (|sum of units|^2 - sum of |unit|^2) / (n (n - 1)); n < 2: 0."""
    units = df.withColumn("_u", unit(as_doubles(F.col(vector))))
    sums = units.groupBy(*group).agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("_u"))).alias("_s"), F.sum(dot(F.col("_u"), F.col("_u"))).alias("_q"))
    mean = F.when(F.col("n") < 2, 0.0).otherwise((dot(F.col("_s"), F.col("_s")) - F.col("_q")) / (F.col("n") * (F.col("n") - 1)))
    return sums.select(*group, "n", mean.alias("avg_similarity"))


def closest_pairs(df: DataFrame, key: str, group: str, vector: str = "vector", blocks: int | None = None, block: int = index.BLOCK, first: int = 8) -> DataFrame:
    """group, max_similarity: the largest cosine of two rows; groups of one are left out. Branch and bound over a metric index, when called.

    The blocks of a lot first meet each other; then pairs of blocks of two lots in the order of what their angles allow at best, `first` of each group and 64 times as many every
    round, until no pair of blocks can beat what its group has. Pairs that can't are never compared, also where a task finds that out by what it has met itself."""
    own = index.build(df, key, vector, group, _rows_a_block(df, blocks, block))

    def compare(met: dict, todo: list) -> Iterator[tuple]:
        top = -np.inf
        for apart, a, b, known in todo:
            if _bound(np.cos, max, apart) <= max(top, -np.inf if known is None else known):
                continue
            (_, x), (_, y) = met[a], met[b]
            for at in range(0, len(x), 512):
                s = x[at : at + 512] @ y.T
                if a == b:
                    s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
                top = max(top, s.max(initial=-np.inf))
        yield ([float(top)],)

    # a zero vector has similarity 0 to all others
    zero = own.rows.groupBy("g").agg(F.count_if(F.col("block").isNull()).alias("z"), F.count("*").alias("n")).where("z > 0 and n > 1").select("g", F.lit(0.0).alias("top"))
    pairs = kept(index.block_pairs(own).withColumn("bound", _bound(F.cos, F.greatest, F.col("apart"), F.lit)))
    best, done, size = zero, pairs.where("la = lb and pairs > 0"), first
    rest = pairs.where("la <> lb")
    while True:
        best = kept(best.unionByName(index.meet(own, done, compare, "top double").select("g", "top")).groupBy("g").agg(F.max("top").alias("top")))
        known = rest.drop("top").join(best.select(F.col("g").alias("bg"), "top"), F.col("g").eqNullSafe(F.col("bg")), "left").where("top is null or bound > top").drop("bg")
        ranked = kept(known.withColumn("nth", F.row_number().over(Window.partitionBy("g").orderBy(F.col("bound").desc(), "a", "b"))))
        if ranked.isEmpty():
            return best.where("top > -2").select(F.col("g").alias(group), F.col("top").alias("max_similarity"))
        done, rest, size = ranked.where(F.col("nth") <= size).drop("nth"), ranked.where(F.col("nth") > size).drop("nth"), size * 64


def _bound(cos, greatest, apart, lit=float):
    """The largest cosine that an angle of at least `apart` allows, as a number or a column."""
    return cos(greatest(apart - index.SLACK, lit(0.0))) + index.SLACK


def diversity_metrics(df: DataFrame, key: str, group: str, vector: str = "vector", text: str | None = None, words: str | None = None) -> DataFrame:
    """Per group: n, avg_similarity, min_distance (1 - largest cosine), word_std (population) of the words of `text`, or of their counts in `words`; groups of one: 0, 1, 0.

    df is written once without its texts, when this is called, as it is read several times."""
    counts = F.col(words) if words else words_of(F.col(text)) if text else None
    df = kept(df.select(key, group, vector, *([] if counts is None else [counts.alias("_words")])))
    top = closest_pairs(df, key, group, vector).select(group, (1 - F.col("max_similarity")).alias("min_distance"))
    out = mean_similarity(df, [group], vector).join(top, group, "left").withColumn("min_distance", F.coalesce("min_distance", F.lit(1.0)))
    if counts is not None:
        out = out.join(df.groupBy(group).agg(F.stddev_pop("_words").alias("word_std")), group)
    return out


def cluster_vectors(df: DataFrame, k: int | None = None, vector: str = "vector", seed: int = 42, restarts: int = 10) -> DataFrame:
    """df with cluster by k-means, k = min(5, n // 2) by default: the cheapest of `restarts` runs from different seeds, trained when this is
    called; fewer than 3 rows or k < 2: one cluster."""
    n = df.count()
    k = min(5, n // 2) if k is None else k
    if n < 3 or k < 2:
        return df.withColumn("cluster", F.lit(0))
    rows = df.withColumn("_x", array_to_vector(as_doubles(F.col(vector))))
    points = rows.select("_x").cache()
    models = [KMeans(k=k, seed=seed + i, featuresCol="_x", predictionCol="cluster").fit(points) for i in range(restarts)]
    points.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost).transform(rows).drop("_x")


def cluster_balance(df: DataFrame, label: str, group: list[str] | None = None) -> DataFrame:
    """clusters and balance = 1 - population deviation of cluster sizes / mean size, within 0 and 1."""
    sizes = df.groupBy(*(group or []), label).agg(F.count("*").alias("c"))
    balance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.stddev_pop("c") / F.avg("c")))
    return sizes.groupBy(*(group or [])).agg(F.count("*").alias("clusters"), balance.alias("balance"))


def is_diverse_enough(metrics: DataFrame, max_avg: float = 0.7, min_dist: float = 0.3) -> DataFrame:
    """metrics with diverse, reason (the gate: fails above max_avg, then below min_dist) and strictly_diverse (both strict)."""
    avg, dist = F.col("avg_similarity"), F.col("min_distance")
    reason = F.when(avg > max_avg, F.lit("average similarity too high")).when(dist < min_dist, F.lit("closest pair too near")).otherwise(F.lit("ok"))
    return metrics.withColumn("reason", reason).withColumn("diverse", F.col("reason") == "ok").withColumn("strictly_diverse", (avg < max_avg) & (dist > min_dist))


def _greedy(ids: np.ndarray, vectors: np.ndarray, relevance: np.ndarray, n: int, lam: float) -> list[int]:
    if n >= len(ids):
        return list(range(len(ids)))
    u = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-10)
    chosen = [int(np.argmax(relevance))]
    near = u @ u[chosen[0]]
    free = np.ones(len(ids), bool)
    free[chosen[0]] = False
    while len(chosen) < n:
        score = np.where(free, lam * relevance - (1 - lam) * near, -np.inf)
        pick = int(np.argmax(score))
        chosen.append(pick)
        free[pick] = False
        near = np.maximum(near, u @ u[pick])
    return chosen


def mmr_select(df: DataFrame, n: int, group: list[str], relevance: str | None = None, lam: float = 0.5, vector: str = "vector") -> DataFrame:
    """Up to n rows of each group with rank: the most relevant, then greedily the greatest lam * relevance - (1 - lam) * largest
    cosine to those chosen; earlier pos on ties. Without relevance all count 1. Groups not larger than n come back whole, by pos.
    A group is held by one task: for groups beyond its memory see mmr_select_global."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        r = pdf[relevance].to_numpy(float) if relevance else np.ones(len(pdf))
        at = _greedy(pdf["pos"].to_numpy(), np.stack(pdf[vector].to_numpy()).astype(float), r, n, lam)
        return pdf.iloc[at].assign(rank=range(1, len(at) + 1))

    schema = T.StructType([*df.schema.fields, T.StructField("rank", T.IntegerType())])
    return df.groupBy(*group).applyInPandas(pick, schema)


def mmr_select_global(df: DataFrame, n: int, relevance: str, lam: float = 0.5, vector: str = "vector", candidates: int = 512) -> DataFrame:
    """pos, rank of n rows of the whole table, chosen as mmr_select does, for any size of table. Runs when called.

    Scores only fall as rows are chosen (0 <= lam <= 1), so those of an earlier pass are upper bounds. A pass scores all rows against what is chosen and brings the best `candidates`
    to the driver; picks go on among these for as long as the best of them beats the bound of all others, which takes several picks a pass. Nothing is written."""
    if not 0 <= lam <= 1:
        raise ValueError("lam must lie between 0 and 1")
    rows = df.select("pos", F.col(relevance).cast("double").alias("r"), unit(as_doubles(F.col(vector))).alias("u"))
    picks: list[int] = []
    chosen = np.empty((0, 0))
    while len(picks) < n:
        top = _best_rows(rows, chosen, set(picks), lam, candidates + 1).collect()  # candidates + 1 rows
        if not top:
            break
        bound = (top[-1]["s"], -top[-1]["pos"]) if len(top) > candidates else None
        top = top[:candidates]
        pos, r, u = np.array([x["pos"] for x in top]), np.array([x["r"] for x in top]), np.array([x["u"] for x in top])
        near = (u @ chosen.T).max(axis=1) if len(picks) else None
        free = np.ones(len(top), bool)
        while len(picks) < n and free.any():
            score = np.where(free, r if near is None else lam * r - (1 - lam) * near, -np.inf)
            best = np.flatnonzero(score == score.max())
            pick = int(best[np.argmin(pos[best])])
            if bound is not None and (score[pick], -pos[pick]) <= bound:
                break
            picks.append(int(pos[pick]))
            free[pick] = False
            chosen = u[pick][None, :] if near is None else np.concatenate([chosen, u[pick][None, :]])
            if near is None and bound is not None:
                break  # the others' scores had no nearness yet: bounds of no use
            near = u @ u[pick] if near is None else np.maximum(near, u @ u[pick])
    return df.sparkSession.createDataFrame([(p, i + 1) for i, p in enumerate(picks)], "pos long, rank int")


def _best_rows(rows: DataFrame, chosen: np.ndarray, taken: set[int], lam: float, count: int) -> DataFrame:
    """pos, r, u, s of the rows with the largest scores, earlier pos first on ties."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[~pdf["pos"].isin(taken)]
            if len(pdf):
                near = (np.stack(pdf["u"].to_numpy()) @ chosen.T).max(axis=1) if len(chosen) else None
                pdf = pdf.assign(s=pdf["r"] if near is None else lam * pdf["r"] - (1 - lam) * near)
                yield pdf.sort_values(["s", "pos"], ascending=[False, True]).head(count)

    return rows.mapInPandas(score, f"pos {dict(rows.dtypes)['pos']}, r double, u array<double>, s double").orderBy(F.col("s").desc(), "pos").limit(count)


def detect_outliers(df: DataFrame, threshold: float = 2.0, vector: str = "vector") -> DataFrame:
    """df with distance to the mean vector and is_outlier: over mean + threshold * population deviation of distances; n < 3: none."""
    centre = df.agg(vector_to_array(Summarizer.mean(array_to_vector(as_doubles(F.col(vector))))).alias("_centre"), F.count("*").alias("_n"))
    far = df.crossJoin(F.broadcast(centre)).withColumn("distance", norm(minus(as_doubles(F.col(vector)), F.col("_centre"))))
    limit = far.agg((F.avg("distance") + threshold * F.stddev_pop("distance")).alias("_limit"))
    return far.crossJoin(F.broadcast(limit)).withColumn("is_outlier", (F.col("_n") >= 3) & (F.col("distance") > F.col("_limit"))).drop("_centre", "_n", "_limit")


def dedup_prompts(df: DataFrame, limit: int | None = None, text: str = "prompt") -> DataFrame:
    """First row by pos of each prompt, blanks around it and case apart; then the first `limit` by pos."""
    key = F.lower(F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", "")))
    w = Window.partitionBy("_key").orderBy("pos")
    out = df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")
    return out.orderBy("pos").limit(limit) if limit else out
