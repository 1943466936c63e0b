"""Edge cases of single operators: empty tables, one row, ties, nulls, sentinels, zero vectors, failures."""

import hashlib
import json
import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from contrail.functions import judge_output as g
from contrail.functions.vectors import cosine, norm, scale_to_norm, unit
from contrail.operators import diversity as d
from contrail.operators import evaluation as e
from contrail.operators import pairs as p
from contrail.operators import quality as q
from contrail.operators import replay as r
from contrail.operators import sampling as m
from contrail.operators import vectors as v
from contrail.plans import inference as inf
from contrail.sources import events as src
from contrail.streaming import sessions as st

VECTORS = "pos long, g string, vector array<double>, w double, is_valid boolean, layer int, layer_strategy string, overall_score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x[0], x[1], x[2] if len(x) > 2 else 1.0, True, 7 + i, "auto", float(x[2] if len(x) > 2 else 1.0)) for i, x in enumerate(rows)], VECTORS)


def log(spark, rows):
    """rows: (session, sequence, type, payload)."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(f"{s}-{n}", s, start + dt.timedelta(seconds=n), n, t.split(".")[0], t, "src", json.dumps(b)) for s, n, t, b in rows], src.ENVELOPE)


def test_vector_functions_on_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>").select(norm(F.col("b")), cosine(F.col("a"), F.col("b")), unit(F.col("a")), scale_to_norm(F.col("b"), 10.0)).first()
    assert list(row) == [5.0, 0.0, [0.0, 0.0], [6.0, 8.0]]


def test_means(spark):
    df = vectors(spark, [("one", [3.0, 4.0]), ("two", [1.0, 0.0], 3.0), ("two", [0.0, 1.0], 1.0), ("zero", [1.0, 0.0]), ("zero", [-1.0, 0.0])])
    mean = {x["g"]: x["vector"] for x in v.mean_vector(df, ["g"]).collect()}
    assert mean["one"] == [3.0, 4.0] and mean["zero"] == [0.0, 0.0] and np.allclose(mean["two"], [math.sqrt(0.5)] * 2)
    weighted = {x["g"]: x["vector"] for x in v.weighted_mean_vector(df, ["g"], "w").collect()}
    assert np.allclose(weighted["two"], np.array([3, 1]) / math.sqrt(10))
    none = vectors(spark, [("a", [1.0, 0.0], 0.0), ("a", [0.0, 1.0], 0.0)])
    assert np.allclose(v.quality_weighted_vector(none, ["g"], "w").first()["vector"], [math.sqrt(0.5)] * 2)
    assert v.mean_vector(df.limit(0), ["g"]).collect() == []
    with pytest.raises(Exception):
        v.mean_vector(vectors(spark, [("a", [1.0]), ("a", [1.0, 2.0])]), ["g"]).collect()


def test_pca_against_svd(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) * [5, 1, 1, 1, 1, 1] + 2
    df = vectors(spark, [("a", list(map(float, row))) for row in x])
    got = np.array(v.pca_vector(df).first()["vector"])
    want = np.linalg.svd(x - x.mean(axis=0))[2][0]
    assert abs(got @ want) > 1 - 1e-9 and abs(np.linalg.norm(got) - 1) < 1e-9 and got @ x.mean(axis=0) >= 0
    shares = [row["share"] for row in v.variance_explained(df).collect()]
    assert abs(sum(shares) - 1) < 1e-9 and shares == sorted(shares, reverse=True)
    assert v.pca_vector(df.limit(1)).first()["vector"] == list(map(float, x[0]))
    w = rng.random(40)
    weighted = v.weighted_pca_vector(df.withColumn("k", F.element_at(F.lit([float(y) for y in w]), (F.col("pos") + 1).cast("int"))), "k").first()["vector"]
    scaled = x * np.sqrt(w / w.sum())[:, None]
    assert abs(np.array(weighted) @ np.linalg.svd(scaled - scaled.mean(axis=0))[2][0]) > 1 - 1e-9


def test_aggregate_needs_a_valid_row(spark):
    df = vectors(spark, [("a", [1.0, 0.0])]).withColumn("is_valid", F.lit(False))
    with pytest.raises(ValueError):
        v.aggregate_vectors(df, "top_k_average")
    with pytest.raises(ValueError):
        v.aggregate_vectors(df, "unknown")


def test_rank_ties_go_to_the_earlier(spark):
    rows = v.rank_samples(vectors(spark, [("a", [1.0], 2.0), ("a", [1.0], 3.0), ("a", [1.0], 3.0)])).orderBy("rank").collect()
    assert [x["pos"] for x in rows] == [1, 2, 0]


@pytest.mark.parametrize("blocks", [1, 3])
def test_near_duplicates(spark, blocks):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(20, 8))
    x = np.vstack([base, base[:5] + 0.01, np.zeros((2, 8))])
    df = vectors(spark, [("a", list(map(float, row))) for row in x])
    unit_x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if unit_x[i] @ unit_x[j] > 0.9}
    assert {(a["left"], a["right"]) for a in d.near_duplicates(df, "pos", 0.9, blocks=blocks).collect()} == want
    assert {(a["left"], a["right"]) for a in d.near_duplicates_lsh(df.where("pos < 25"), "pos", 0.9).collect()} == want
    assert d.near_duplicates(df.limit(0), "pos").collect() == []
    metrics = d.diversity_metrics(df.where("pos < 20"), "pos", "g").first()
    sims = [float(unit_x[i] @ unit_x[j]) for i in range(20) for j in range(i + 1, 20)]
    assert math.isclose(metrics["avg_similarity"], np.mean(sims), abs_tol=1e-9) and math.isclose(metrics["min_distance"], 1 - max(sims), abs_tol=1e-6)
    one = d.diversity_metrics(df.where("pos = 3"), "pos", "g").first()
    assert (one["avg_similarity"], one["min_distance"]) == (0.0, 1.0)


def test_mmr(spark):
    df = vectors(spark, [("a", [1.0, 0.0], 1.0), ("a", [1.0, 0.01], 0.99), ("a", [0.0, 1.0], 0.5), ("b", [1.0, 0.0], 0.1)])
    got = d.mmr_select(df, 2, ["g"], "w").orderBy("g", "rank").collect()
    assert [(x["g"], x["pos"]) for x in got] == [("a", 0), ("a", 2), ("b", 3)]
    assert [x["pos"] for x in d.mmr_select_global(df.where("g = 'a'"), 2, "w").orderBy("rank").collect()] == [0, 2]


def test_outliers_need_three_rows(spark):
    df = vectors(spark, [("a", [0.0]), ("a", [100.0])])
    assert not any(x["is_outlier"] for x in d.detect_outliers(df).collect())
    many = vectors(spark, [("a", [float(i % 2)]) for i in range(30)] + [("a", [100.0])])
    assert [x["pos"] for x in d.detect_outliers(many).where("is_outlier").collect()] == [30]


def test_gates_and_sentinels(spark):
    rows = spark.createDataFrame([(1, 6.0, 7.0, -1.0, -1.0), (2, 6.0, 7.0, 4.0, -1.0), (3, 5.9, 7.0, 9.0, 9.0), (4, 9.0, 9.0, 9.0, 4.9)], "id int, dimension double, structural double, marker double, boundary double")
    assert [x["gate"] for x in p.gate_pairs(rows).orderBy("id").collect()] == [True, False, False, False]
    assert [x["gate"] for x in p.gate_pairs(rows, False, False).orderBy("id").collect()] == [True, True, False, True]


def test_chain_skips_what_failed(spark):
    df = spark.range(6).withColumnRenamed("id", "pair_id")
    seen = []

    def stage(name, ok, quality):
        def run(x):
            seen.append((name, x.count()))
            return x.withColumn("stage_valid", ok).withColumn("stage_quality", F.lit(float(quality)))

        return name, run

    stages = [stage("a", F.col("pair_id") % 2 == 0, 3), stage("b", F.when(F.col("pair_id") != 4, F.col("pair_id") > 0), 8)]
    out = {x["pair_id"]: (x["is_valid"], x["contrast_quality"], x["failed_stage"]) for x in p.validate_chain(df, stages).collect()}
    assert seen == [("a", 6), ("b", 3)]
    assert out == {0: (False, 8.0, "b"), 1: (False, 3.0, "a"), 2: (True, 8.0, None), 3: (False, 3.0, "a"), 4: (False, 3.0, "b"), 5: (False, 3.0, "a")}
    assert p.validate_chain(df, []).first()["contrast_quality"] == 5.0
    assert p.distance_of_score(4.0) == pytest.approx(0.28)


def test_positions_and_intensities(spark):
    df = spark.createDataFrame([(x,) for x in (9, 4, 7, 1, 30, 22, 5)], "pos long").repartition(3)
    assert sorted((x["pos"], x["position"]) for x in p.with_position(df).collect()) == [(x, i) for i, x in enumerate(sorted((9, 4, 7, 1, 30, 22, 5)))]
    got = [x["intensity"] for x in m.assign_intensity(df, {"extreme": 0.3, "natural": 0.7}).orderBy("pos").collect()]
    assert got == ["extreme"] * 2 + ["natural"] * 5
    assert m.assign_intensity(df.limit(0), {"high": 1.0}).collect() == []


def test_subsample_sizes(spark):
    df = spark.range(100).withColumnRenamed("id", "pos").withColumn("g", F.col("pos") % 3)
    assert m.subsample(df, 0.25).count() == 25 and m.subsample(df, 2.0).count() == 100 and m.subsample(df, 0.5, max_rows=7).count() == 7
    assert sorted(m.subsample(df, 0.25).collect()) == sorted(m.subsample(df.repartition(4), 0.25).collect())
    assert {x["g"]: x["count"] for x in m.subsample(df, 0.001, group=["g"]).groupBy("g").count().collect()} == {0: 1, 1: 1, 2: 1}


def test_territories(spark):
    seeds = spark.createDataFrame([(i, float(i % 5), [f"c{i % 3}"] if i % 4 else [], {"formality": "casual" if i < 16 else "formal"}) for i in range(20)], "pos long, quality_score double, target_components array<string>, attributes map<string,string>")
    rows = m.assign_territory(seeds, 4, 8).collect()
    by = {s: [x["pos"] for x in rows if x["sample_idx"] == s] for s in range(4)}
    assert all(len(x) == 8 == len(set(x)) for x in by.values())
    assert all({i % 3 for i in x if i % 4} == {0, 1, 2} for x in by.values())
    balanced = m.assign_territory(seeds, 4, 6, balance=("formality",)).collect()
    before = m.assign_territory(seeds, 4, 6).collect()
    casual = lambda rows, s: sum(x["pos"] < 16 for x in rows if x["sample_idx"] == s)
    assert all(casual(balanced, s) <= casual(before, s) for s in range(4)) and any(casual(balanced, s) < casual(before, s) for s in range(4))
    assert m.assign_territory(seeds.limit(0), 2, 3).collect() == []


def _territory(seeds, sample: int, num_samples: int, per_sample: int, coverage: bool, randomize: bool) -> list[int]:
    """The rule on one machine: positions in `seeds`, best quality first, for one sample."""
    n = len(seeds)
    quota = min(per_sample, n)
    chosen: list[int] = []
    if coverage:
        by: dict[str, list[int]] = {}
        for i, components in enumerate(seeds["target_components"]):
            for c in components if len(components) else ["_general"]:
                by.setdefault(c, []).append(i)
        names = sorted(by)
        if randomize:
            names.sort(key=lambda c: (m.hash_text(f"{sample}/{c}"), c))
        for c in names:
            if len(chosen) == quota:
                break
            mine = by[c]
            for j in range(len(mine)):
                i = mine[(sample + j) % len(mine)]
                if i not in chosen:
                    chosen.append(i)
                    break
    taken = set(chosen)
    free = [i for i in range(n) if i not in taken]
    start = sample * len(free) // max(num_samples, 1)
    return chosen + [free[(start + j) % len(free)] for j in range(min(quota - len(chosen), len(free)))]


def _balance(seeds, chosen: list[int], keys: tuple[str, ...], sample: int) -> list[int]:
    """Swap up to two rows of a value that covers over half of the sample for unchosen seeds with another."""
    chosen = list(chosen)
    for key in keys:
        values = [(a or {}).get(key) for a in seeds["attributes"]]
        own = [values[i] for i in chosen]
        for value in sorted({v for v in own if v}):
            if own.count(value) * 2 <= len(own):
                continue
            spare = sorted((i for i in range(len(seeds)) if i not in chosen and values[i] not in (None, value)), key=lambda i: (m.hash_text(f"{sample}/{key}/{i}"), i))
            for j in [j for j, v in enumerate(own) if v == value][-2:]:
                if spare:
                    chosen[j] = spare.pop(0)
                    own[j] = values[chosen[j]]
    return chosen


@pytest.mark.parametrize("n,samples,per,coverage,randomize,balance", [(300, 7, 20, True, True, ("formality", "domain")), (90, 5, 6, True, False, ("domain", "formality")), (5, 3, 9, True, True, ("formality",)), (100_500, 3, 8, False, False, ()), (100_500, 3, 8, True, True, ("formality",))])
def test_territories_of_any_number_of_seeds(spark, n, samples, per, coverage, randomize, balance):
    parts = ["case when id % 17 = 0 then cast(array() as array<string>) when id % 3 = 0 then array(concat('c', id % 6), concat('c', id % 4)) else array(concat('c', id % 6)) end as target_components"]
    parts += ["if(id % 19 = 0, null, (id * 11) % 101 / 10D) as quality_score", "map('formality', if(id % 9 = 0, 'formal', 'casual'), 'domain', if(id % 5 = 0, null, concat('d', id % 2))) as attributes"]
    seeds = spark.range(n).selectExpr("id as pos", *parts)
    got = m.assign_territory(seeds, samples, per, coverage, randomize, balance).toPandas()
    table = seeds.toPandas().sort_values(["quality_score", "pos"], ascending=[False, True], kind="stable").reset_index(drop=True)
    for s in range(samples):
        want = _territory(table, s, samples, per, coverage, randomize)
        want = _balance(table, want, balance, s) if balance else want
        assert got[got["sample_idx"] == s].sort_values("slot")["pos"].tolist() == table["pos"].iloc[want].tolist()


def test_quality_bounds(spark):
    rows = spark.createDataFrame([(1, 0.9, -1.0, False, True), (2, None, None, None, None), (3, -0.5, 0.5, True, False)], "datapoint_id long, influence double, alignment double, steered_matches boolean, is_outlier boolean")
    got = {x["datapoint_id"]: (x["quality_score"], x["recommendation"]) for x in q.quality_score(rows).collect()}
    assert got == {1: (0.0, "REMOVE"), 2: (1.0, "KEEP"), 3: (1.0, "KEEP")}


def test_tournament_presets(spark):
    plan = lambda *a: [(x["rows"], x["survivors"]) for x in e.tournament_plan(spark, *a).orderBy("round").collect()]
    assert plan(2, 16, 0.75) == [(256, 64), (64, 16), (16, 16)] and plan(1, 4, 0.875) == [(32, 4), (4, 4)]
    assert plan(3, 32, 0.685)[0][0] == 1023 and plan(3, 32, 0.685)[-1][0] == 31


def test_pairing_takes_the_latest_open_request(spark):
    rows = [("s", 1, "llm.request", {"request_id": "a", "model": "x"}), ("s", 2, "llm.request", {"request_id": "a", "model": "y"}), ("s", 3, "llm.response", {"request_id": "a", "usage": {"total_tokens": 5}}), ("s", 4, "llm.response", {"request_id": "a"}), ("s", 5, "llm.response", {"request_id": "b"})]
    got = r.pair_llm_calls(log(spark, rows)).collect()
    assert [(x["first_sequence"], x["second_sequence"], x["model"], x["tokens"]) for x in got] == [(2, 3, "y", 5)]
    assert r.pair_llm_calls(log(spark, rows).limit(0)).collect() == []


def test_replay_state_against_a_loop(spark):
    import random

    rng = random.Random(3)
    kinds = ["session.started", "session.completed", "contrast.pipeline_started", "contrast.pipeline_completed", "optimization.started", "evaluation.started", "evaluation.completed", "vector.selected", "llm.response", "optimization.aggregation_completed"]
    rows = []
    for s in range(20):
        for n in range(rng.randrange(1, 25)):
            body = {"success": rng.random() < 0.5, "final_score": rng.choice([None, rng.random()]), "final_layer": rng.choice([None, 3]), "scores": {"overall": round(rng.random(), 3)}, "layer": rng.randrange(9), "strength": 1.5, "score": rng.choice([None, round(rng.random(), 3)]), "usage": {"total_tokens": n}}
            rows.append((f"s{s}", n + 1, rng.choice(kinds), body))
    got = {x["session_id"]: x for x in r.replay_state(log(spark, rows)).collect()}
    for s in range(20):
        progress = score = 0.0
        phase = ""
        for _, _, kind, b in [x for x in rows if x[0] == f"s{s}"]:
            if kind == "session.started":
                phase = "initializing"
            elif kind == "session.completed":
                progress, phase = 1.0, "complete" if b["success"] else "failed"
                score = b["final_score"] if b["final_score"] is not None else score
            elif kind.startswith("contrast"):
                progress = 0.1 if kind.endswith("started") else 0.4
                phase = "generating" if kind.endswith("started") else phase
            elif kind == "optimization.started":
                progress, phase = max(progress, 0.4), "extracting"
            elif kind == "evaluation.started":
                progress, phase = max(progress, 0.7), "evaluating"
            elif kind == "evaluation.completed":
                progress, score = max(progress, 0.9), max(score, b["scores"]["overall"])
            elif kind == "vector.selected" and b["score"] is not None:
                score = b["score"]
            elif kind == "optimization.aggregation_completed" and b["final_score"] is not None:
                score = b["final_score"]
        x = got[f"s{s}"]
        assert (x["phase"], x["progress"], x["best_score"]) == (phase, pytest.approx(progress), pytest.approx(score))


def test_judge_text(spark):
    texts = ['{"score": 7}', "```json\n{\"score\": 3}\n```", "so {\"score\": 2} it is", "99 then 8.5", "nothing", "", None, '{"other": 1}', "[1, 2]", '{"a": 1} {"b": 2}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", g.extract_score(F.col("t")).alias("s"), g.parse_llm_json(F.col("t")).isNotNull().alias("j")).orderBy("i").collect()
    assert [x["s"] for x in rows][:8] == [7.0, 3.0, 2.0, 8.5, 5.0, 5.0, 5.0, 5.0]
    assert [x["j"] for x in rows] == [True, True, True, False, False, False, False, True, True, False]
    bad = spark.createDataFrame([(1, "x", 2), (2, None, 1), (3, '{"results": [{"score": 1}, {"score": 2}]}', 1)], "i int, t string, n int")
    got = g.explode_judge_results(bad, "t", "n").orderBy("i", "output_index").collect()
    assert [(x["i"], x["score"], x["reasoning"]) for x in got] == [(1, 5.0, "Parse error"), (1, 5.0, "Parse error"), (2, 5.0, "Parse error"), (3, 1.0, "")]


def flaky():
    def client(prompts):
        if any("bad" in x for x in prompts):
            raise RuntimeError("refused")
        return [x.upper() for x in prompts]

    return client


def test_inference_survives_bad_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, None), (4, "longer than the clip")], "i int, t string").coalesce(1)
    got = {x["i"]: (x["response"], x["error"]) for x in inf.batch_infer(df, flaky, "<{t}>", clip={"t": 6}, max_retries=1, default="?").collect()}
    assert got == {1: ("<GOOD>", None), 2: ("?", "refused"), 3: ("<>", None), 4: ("<LONGER>", None)}
    assert inf.batch_infer(df.limit(0), flaky, "{t}").collect() == []


def test_log_files_skip_bad_lines(spark, tmp_path):
    good = {"event_id": "e", "session_id": "s", "timestamp": "2024-01-01T00:00:00Z", "sequence": 1, "category": "llm", "event_type": "llm.request", "source": "x", "payload": {"request_id": "a"}}
    lines = [json.dumps(good), "", "{broken", json.dumps(good | {"category": "odd"}), json.dumps({k: x for k, x in good.items() if k != "sequence"}), json.dumps(good | {"sequence": 2, "event_type": "llm.response"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert [x["sequence"] for x in src.read_events(spark, str(tmp_path)).orderBy("sequence").collect()] == [1, 2]
    assert src.read_events(spark, str(tmp_path), event_types=["llm.response"], after_sequence=1).count() == 1
    assert src.read_quarantine(spark, str(tmp_path)).count() == 3
    assert src.events_of(src.read_events(spark, str(tmp_path)), "llm.request").first()["request_id"] == "a"


def test_session_folders(spark, tmp_path):
    for name, body in (("one", '{"session_id": "one", "created_at": "2024-01-02T00:00:00Z"}'), ("two", '{\n"session_id": "two", "status": "failed"}'), ("bad", "{"), (".dot", '{"session_id": "dot"}')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(body)
    found = src.read_session_metadata(spark, str(tmp_path))
    assert [x["session_id"] for x in src.list_sessions(found).collect()] == ["one", "two"]
    assert src.latest_session(found).first()["session_id"] == "one"
    info = {x["session_id"]: x for x in src.session_info(found).collect()}
    assert info["one"]["duration"] == 0.0 and info["one"]["behavior"] == "Unknown" and info["two"]["created"] is not None


def test_tournament_ranks_by_ranges(spark):
    rows = spark.range(3000).selectExpr("id as sample_idx", "id as pos", "id % 7 <> 0 as is_valid", "explode(array(0, 1)) as round", "if(id % 11 = 0, null, id % 101 / 10D) as score")
    out = e.run_tournament(rows, [(0, 50), (1, 9)])
    assert "windowspecdefinition(round" not in out._jdf.queryExecution().optimizedPlan().toString()
    worth = lambda i: 0.0 if i % 7 == 0 else None if i % 11 == 0 else i % 101 / 10
    order = sorted(range(3000), key=lambda i: (worth(i) is None, -(worth(i) or 0), i))
    got = {x["sample_idx"]: (x["rank"], x["survived"]) for x in out.where("round = 0").collect()}
    assert got == {i: (n + 1, n < 50) for n, i in enumerate(order)}
    assert [x["sample_idx"] for x in out.where("round = 1").orderBy("rank").collect()] == order[:50]


def test_prompts_of_all_documents(spark):
    from contrail.queries import outputs

    docs = f"{SMALL}/documents.parquet"
    got = outputs.QUERIES["c12_attach_eval_prompts"](spark, SMALL).collect()
    langs = {x[0] for x in spark.read.parquet(docs).select("lang").distinct().collect()}
    assert {x["prompt"] for x in got if x["origin"] == 1} == langs and {x["origin"] for x in got} == {1, 2, 3}
    made = outputs.QUERIES["c12_attach_eval_prompts_generated"](spark, SMALL).collect()
    assert len(made) == 20 and {x["origin"] for x in made} == {0}


def test_ranks_in_groups_of_any_kind(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 7), (None, 2), (None, 9), ("b", 5)], "g string, pos int")
    got = {(x["g"], x["pos"]): x["rank"] for x in p.with_rank(rows, ["g"], F.col("pos")).collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, (None, 2): 1, (None, 7): 2, (None, 9): 3, ("b", 5): 1}
    assert p.with_rank(rows.limit(0), [], F.col("pos")).collect() == []
    sums = {x["pos"]: x["before"] for x in p.with_running_sum(rows, "pos", F.col("pos"), "before").collect()}
    assert sums == {1: 0, 2: 1, 3: 3, 5: 6, 7: 11, 9: 18}


def test_batches_of_one_prompt_are_cut(spark):
    rows = spark.createDataFrame([(i, "p" if i < 7 else None, str(i)) for i in range(9)], "pos int, prompt string, output string")
    got = g.judge_batches(rows, size=3).collect()
    assert all(x["n"] == len(x["outputs"]) <= 3 for x in got) and sorted(o["pos"] for x in got for o in x["outputs"]) == list(range(9))
    assert {x["batch_key"] for x in got} == {"p", "unknown"}
    assert {x["batch_key"] for x in g.judge_batches(rows, None).collect()} == set(map(str, range(9)))


@pytest.mark.parametrize("honor", [False, True])
def test_rollback_against_a_loop(spark, honor):
    kinds = [("s", 1, "state.update", {}), ("s", 2, "state.update", {}), ("s", 3, "checkpoint.rollback", {"previous_sequence": 1}), ("s", 4, "state.update", {}), ("s", 5, "checkpoint.rollback", {"previous_sequence": 8}), ("s", 6, "state.update", {}), ("s", 9, "state.update", {}), ("s", 10, "checkpoint.rollback", {}), ("t", 2, "state.update", {})]
    want = set()
    for session, n, kind, _ in kinds:
        marks = [(m, b.get("previous_sequence", 0)) for s, m, k, b in kinds if s == session and k == "checkpoint.rollback"]
        gone = any(to < n < m if honor else m < n <= to for m, to in marks)
        want |= {(session, n)} if kind != "checkpoint.rollback" and not gone else set()
    assert {(x["session_id"], x["sequence"]) for x in r.apply_rollback(log(spark, kinds), honor).collect()} == want


def test_children_of_a_replay(spark):
    events = log(
        spark,
        [
            ("s", 1, "seed.generated", {"seed_id": "a", "scenario": "old"}), ("s", 2, "seed.generated", {"seed_id": "a", "scenario": "new", "quality_score": 2.5, "is_core": True}),
            ("s", 3, "optimization.completed", {"layer": 3, "success": False, "error": "x"}), ("s", 4, "optimization.completed", {"layer": 3, "final_loss": 0.5, "success": True}), ("s", 5, "evaluation.completed", {}),
        ],
    )
    assert [tuple(x) for x in r.replay_seeds(events).select("seed_id", "scenario", "quality_score", "is_core").collect()] == [("a", "new", 2.5, True)]
    assert sorted((x["sequence"], x["success"], x["error"]) for x in r.replay_optimizations(events).collect()) == [(3, False, "x"), (4, True, None)]
    assert [tuple(x)[2:] for x in r.replay_evaluations(events).collect()] == [("", "quick", 0.0, "needs_refinement", 1.0)]
    assert all(f.replay_seeds(events.limit(0)).collect() == [] for f in (r,))


def test_every_payload_has_a_view(spark):
    assert len(src.PAYLOADS) == 40 and {k.split(".")[0] for k in src.PAYLOADS} <= set(src.CATEGORIES)
    events = log(spark, [("s", 1, "evaluation.progress", {"evaluation_id": "e", "phase": "judging", "completed": 2, "total": 9}), ("s", 2, "evaluation.progress", {})])
    assert [(x["completed"], x["total"]) for x in src.events_of(events, "evaluation.progress").orderBy("sequence").collect()] == [(2, 9), (None, None)]


def test_analysis_parts(spark):
    texts = ['{"behavioral_test": {"distinguishing_variable": "v"}, "intensity_calibration": {"high_looks_like": "h"}}', '{"behavioral_test": {"description": "d"}, "intensity_calibration": {"high_looks_like": ""}}', "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [(x["i"], x["distinguishing_variable"], x["description"]) for x in g.behavioral_test(df, "t").collect()] == [(0, "v", "")]
    assert [(x["i"], x["high"], x["natural"]) for x in g.intensity_calibration(df, "t").collect()] == [(0, "h", g.LOOKS["natural"])]
    found = src.new_sessions(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "session_id string"), spark.createDataFrame([("b",)], "session_id string"))
    assert [x["session_id"] for x in found.collect()] == ["a"]


def test_inference_takes_long_texts_in_portions(spark):
    """A client gets about PROMPTS bytes at a time, not as many rows as an Arrow batch happens to hold; a longer prompt comes alone."""
    rows = spark.createDataFrame([(i, "é" * 500_000 if i != 7 else "x" * 9_000_000) for i in range(20)], "i int, t string").coalesce(1)
    sizes = lambda: lambda prompts: [f"{len(prompts)} {sum(len(p.encode()) for p in prompts)}" for _ in prompts]
    got = [tuple(map(int, x["response"].split())) for x in inf.batch_infer(rows, sizes, "{t}").collect()]
    assert len(got) == 20 and all(n == 1 or size <= inf.PROMPTS for n, size in got) and (1, 9_000_000) in got and max(n for n, _ in got) > 1


def test_chunks_of_any_text_come_back(spark, tmp_path):
    """Cut by code points, line ends included; each payload is parsed once."""
    from contrail.queries.events import QUERIES

    texts = ["", "a", "x" * 20, "y" * 21, "line\n\r\u2028end " * 9, "\U0001f600é" * 33]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["d30_reassemble_chunks"](spark, str(tmp_path))
    assert {x["request_id"]: x["text_md5"] for x in out.collect()} == {f"r{i}": hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(texts)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan
