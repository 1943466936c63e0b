"""Pruned searches against all pairs and plain greedy choice."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from contrail.functions.vectors import norm, unit
from contrail.operators import diversity as d
from contrail.operators import metric_index as index
from contrail.queries.vectors import QUERIES


def clustered(seed, clusters=12, size=60, dims=8, spread=0.05):
    """Tight clusters, some exact copies, two zero vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    v = np.concatenate([c + spread * rng.normal(size=(size, dims)) for c in centres])
    v[5:25] = v[4]
    v[30:32] = 0
    return v


def frame(spark, v, groups=1):
    return spark.createDataFrame([(i, i % groups if i % 11 else None, x.tolist(), float(i * 7 % 101)) for i, x in enumerate(v)], "id long, g int, vector array<double>, r double").repartition(3)


def cosine(v):
    u = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)
    return u @ u.T


@pytest.mark.parametrize("threshold,pivots,block", [(0.95, 9, 20), (0.5, 20, 64), (0.0, 3, 500), (-0.3, 4, 100), (0.999999, 1, 16)])
def test_near_duplicates_are_all_pairs(spark, threshold, pivots, block):
    v = clustered(1)
    s = cosine(v)
    got = {(x["left"], x["right"]): x["similarity"] for x in d.near_duplicates(frame(spark, v), "id", threshold, block=block, pivots=pivots).collect()}
    sure = {(i, j) for i, j in zip(*np.nonzero(s > threshold + 1e-9)) if i < j}
    may = {(i, j) for i, j in zip(*np.nonzero(s > threshold - 1e-9)) if i < j}
    assert sure <= set(got) <= may
    assert all(abs(got[p] - s[p]) < 1e-9 for p in got)


def test_clustered_vectors_are_hardly_compared(spark):
    v = clustered(2, clusters=40, size=60)
    row = d.compared_pairs(frame(spark, v), "id", 0.95, block=100, pivots=40).first()
    assert row["rows"] == 2400 and row["pairs"] == 2400 * 2399 // 2
    assert row["compared"] < 0.1 * row["pairs"]


def test_no_vectors(spark):
    none = frame(spark, np.empty((0, 3)))
    assert d.near_duplicates(none, "id").collect() == [] and d.closest_pairs(none, "id", "g").collect() == []
    assert tuple(d.compared_pairs(none, "id").first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("seed,block", [(3, 10), (4, 50)])
def test_closest_pairs_of_groups(spark, seed, block):
    v = clustered(seed, spread=0.3)
    v[60:] += np.arange(len(v) - 60)[:, None] % 7
    df = frame(spark, v, 5)
    got = {x["g"]: x["max_similarity"] for x in d.closest_pairs(df, "id", "g", block=block, first=1).collect()}
    group = np.array([i % 5 if i % 11 else -1 for i in range(len(v))])
    s = cosine(v)
    np.fill_diagonal(s, -np.inf)
    for g in range(-1, 5):
        own = np.flatnonzero(group == g)
        assert abs(got[g if g >= 0 else None] - s[np.ix_(own, own)].max()) < 1e-9


def test_bounds_hold():
    """No pair is nearer than its blocks' angles to the pivots say."""
    rng = np.random.default_rng(6)
    u = rng.normal(size=(200, 5))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    far = index.angles(u, index.farthest_first(u, 6))
    real = index.angles(u, u)
    assert (np.abs(far[:, None, :] - far[None, :, :]).max(axis=2) <= real + index.SLACK).all()


@pytest.mark.parametrize("lam,candidates", [(0.5, 40), (0.9, 15), (1.0, 5), (0.0, 300)])
def test_lazy_choice_is_plain_greedy(spark, lam, candidates):
    v = clustered(7, spread=0.4)
    df = frame(spark, v).withColumnsRenamed({"id": "pos"}).withColumn("r", F.col("r") / 101)
    r = np.array([i * 7 % 101 for i in range(len(v))]) / 101
    want = d._greedy(np.arange(len(v)), v, r, 100, lam)
    got = [x["pos"] for x in d.mmr_select_global(df, 100, "r", lam, candidates=candidates).orderBy("rank").collect()]
    assert len(got) == 100 == len(set(got))
    if lam not in (0.0, 1.0):  # else scores tie within rounding
        assert got == want


def test_picks_share_passes(spark, monkeypatch):
    passes, whole = [], d._best_rows
    monkeypatch.setattr(d, "_best_rows", lambda *a: passes.append(1) or whole(*a))
    df = frame(spark, clustered(8, spread=0.4)).withColumnsRenamed({"id": "pos"})
    assert d.mmr_select_global(df.withColumn("r", F.col("r") / 101), 100, "r", 0.7, candidates=256).count() == 100
    assert len(passes) < 25


@pytest.mark.parametrize("part", [7, 50, 32_768])
def test_lsh_meets_what_shares_a_bucket(spark, part):
    """Each pair once that shares a bucket and is near enough, whatever parts the buckets are dealt to."""
    v, tables, bits = clustered(9, spread=0.4), 5, 3
    s = cosine(v)
    planes = np.random.default_rng(5).normal(size=(v.shape[1], tables * bits))
    codes = (v @ planes > 0).reshape(len(v), tables, bits) @ (1 << np.arange(bits))
    shared = (codes[:, None, :] == codes[None, :, :]).any(axis=2) & (np.linalg.norm(v, axis=1) > 0)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(shared & (s > 0.8))) if i < j}
    got = [(x["left"], x["right"], x["similarity"]) for x in d.near_duplicates_lsh(frame(spark, v), "id", 0.8, tables=tables, bits=bits, part=part).collect()]
    assert sorted(x[:2] for x in got) == sorted(want) and len(want) < (s[np.triu_indices(len(v), 1)] > 0.8).sum()
    assert all(abs(c - s[a, b]) < 1e-9 for a, b, c in got)
    assert d.near_duplicates_lsh(frame(spark, np.empty((0, 3))), "id").collect() == []


def test_a_norm_is_computed_once(spark):
    """Not once for each element of its vector."""
    rows = spark.range(60).select(F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: (i + F.col("id")).cast("double")).alias("v"))
    began = time.monotonic()
    assert abs(rows.select(F.round(norm(unit(F.col("v"))), 9).alias("n")).agg(F.sum("n")).first()[0] - 60) < 1e-6
    assert time.monotonic() - began < 15


def test_a_row_is_sent_once_for_each_lot(spark):
    """Not once for each block of the index, all pairs of which meet here."""
    own = index.build(frame(spark, clustered(10)), "id", block=10, lots=200)
    sent = index.meet(own, index.block_pairs(own), lambda blocks, todo: iter([([sum(len(ids) for ids, _ in blocks.values())], [len(todo)])]), "n long, pairs long")
    n, pairs = sent.agg(F.sum("n"), F.sum("pairs")).first()
    lots, blocks = own.blocks.select("lot").distinct().count(), own.blocks.count()
    assert pairs == blocks * (blocks + 1) // 2 and blocks > 8 * lots > 8
    assert n == 718 * lots  # two are zero vectors


def test_lots_change_no_pair(spark):
    pairs = [{(x["left"], x["right"]) for x in d.near_duplicates(frame(spark, clustered(11)), "id", 0.6, block=30, lots=lots).collect()} for lots in (40, None, 10_000)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 1000


def test_few_rounds_where_nothing_can_be_ruled_out(spark, monkeypatch):
    rounds, whole = [], index.meet
    monkeypatch.setattr(index, "meet", lambda *a: rounds.append(1) or whole(*a))
    v = np.random.default_rng(12).normal(size=(400, 16))
    s = cosine(v)
    np.fill_diagonal(s, -np.inf)
    assert abs(d.closest_pairs(frame(spark, v).withColumn("g", F.lit(1)), "id", "g", block=8).first()["max_similarity"] - s.max()) < 1e-9
    assert len(rounds) <= 4


def exchanged(df):
    """Columns that a plan shuffles."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return {c.split("#")[0].strip() for cols in re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", plan) for c in cols.split(",")}


def test_diversity_moves_neither_texts_nor_angles(spark, monkeypatch):
    """Words are counted before the join; a row's angles to the pivots, wider than its vector, stay in the task that computes them."""
    written, whole = [], index.kept
    for module in (index, d):
        monkeypatch.setattr(module, "kept", lambda df: written.append(df) or whole(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = QUERIES["d1_d4_diversity_metrics"](spark, SMALL)
        moved = set().union(*map(exchanged, [*written, out]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "words" in moved and not {"text", "far"} & (moved | {c for df in written for c in df.columns})


def test_words_by_whitespace(spark):
    texts = ["", "  ", " a\tb\n", "a\x0bb   c d", "a\x1cb\x85c d", "x", "\r\n\f", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", d.words_of(F.col("t")).alias("n")).orderBy("i").collect()
    assert [x["n"] for x in got] == [len(re.findall(r"[^ \t\n\x0b\f\r]+", t or "")) for t in texts]


@pytest.mark.parametrize("held", [2, 4096])
def test_blocks_cover_their_rows(spark, monkeypatch, held):
    """Also where a task hands on what it has of a block more than once."""
    monkeypatch.setattr(index, "HELD", held)
    v = clustered(13)
    own = index.build(frame(spark, v, 3), "id", group="g", block=20, pivots=9)
    rows = own.rows.where("block is not null").groupBy("g", "block").agg(F.count("*").alias("rows"))
    both = own.blocks.alias("a").join(rows.alias("b"), F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.block") == F.col("b.block")), "full").select("n", "rows", "lo", "hi").collect()
    assert len(both) > 20 and all(x["n"] == x["rows"] and (np.array(x["lo"]) <= x["hi"]).all() for x in both) and sum(x["n"] for x in both) == len(v) - 2
    taken = spark.createDataFrame(own.rows.collect(), own.rows.schema)  # pivots are rows of the table, and all of it is the sample
    near = np.array([x["v"] for x in taken.orderBy(F.xxhash64("id")).collect()])
    near = near[np.linalg.norm(near, axis=1) > 0]
    pivots = index.farthest_first(near / np.linalg.norm(near, axis=1, keepdims=True), 9)
    edges = {(x["g"], x["block"]): (np.array(x["lo"]), np.array(x["hi"])) for x in own.blocks.collect()}
    for x in own.rows.where("block is not null").collect():
        far = index.angles(np.array(x["v"])[None] / np.linalg.norm(x["v"]), pivots)[0]
        lo, hi = edges[x["g"], x["block"]]
        assert (lo <= far + index.SLACK).all() and (far <= hi + index.SLACK).all()


def test_vectors_of_two_lengths_are_an_error():
    with pytest.raises(ValueError):
        index.matrix(pa.chunked_array([pa.array([[1.0, 2.0], [1.0, 2.0, 3.0, 4.0]])]))


def test_a_lot_meets_itself_in_one_round(spark, monkeypatch):
    """All pairs of blocks of a lot, for which its rows are sent once."""
    rounds, whole = [], index.meet
    monkeypatch.setattr(index, "meet", lambda own, pairs, *a: rounds.append(pairs) or whole(own, pairs, *a))
    d.closest_pairs(frame(spark, np.random.default_rng(14).normal(size=(400, 16))).withColumn("g", F.lit(1)), "id", "g", block=8)
    assert rounds[0].where("la = lb and a <> b").count() > 0 and all(x.where("la = lb").count() == 0 for x in rounds[1:])


def test_a_sample_is_cut_before_it_is_sorted(spark, monkeypatch):
    monkeypatch.setattr(index, "SAMPLE", 20)
    rows = spark.range(1000, numPartitions=7)
    low = index._lowest(rows, 1000)
    first = lambda df: [x["id"] for x in df.orderBy(F.xxhash64("id")).limit(20).collect()]
    assert 20 <= low.count() < 80 and first(low) == first(rows)
    assert index._lowest(rows, 30).count() == index._lowest(rows, 0).count() == 1000
