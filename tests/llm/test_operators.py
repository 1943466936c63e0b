"""Operators on small tables: brute force, round trips, edge cases."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from oracle import duck, ours
from pyspark.sql import functions as F

from contrail.llm import catalog, decontamination, html_text, minhash_dedup, mixing, repeats, ring, substring_dedup, suffix_dedup, toxicity, url_filter, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, texts, start=0, **more):
    rows = [(start + i, t, "en", f"s{i % 3}" if i % 7 else None, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, blanks, one word, copies, near copies, shared passages, periodic and long texts, other scripts."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 12, 60, 90, 150, 300)]
    passage = words(rng, 60)
    near = base[4].split()
    near[10] = "changed"
    out = [None, "", "  \n\t ", "one", "one", *base, base[3], base[3], " ".join(near), f"{words(rng, 30)} {passage} {words(rng, 9)}", f"{passage}", f"{words(rng, 50)}\n{passage}"]
    out += ["ab " * 200, "x" * 700, "x" * 450, "é" * 150 + " ü" * 120, base[5].upper(), words(rng, 5000), "\x00\x01 nul " * 40]
    return out


def rows_by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- registered queries ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    assert ours(catalog.queries()[name](spark, SMALL)) == duck(catalog.oracle_sql()[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_is_whole(spark, name):
    table = "pages" if name.startswith(("op6", "op9")) else "documents"
    assert catalog.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not n.startswith(("op6", "op9", "op11", "op12", "op13"))])
def test_empty_documents(spark, name):
    empty = frame(spark, []).withColumnRenamed("n_chars", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    run = {
        "op1_winnowing": lambda: winnowing.fingerprints(empty), "op2_toxicity": lambda: toxicity.toxicity(empty, labels), "op3_ring_sharding": lambda: ring.assign_shards(empty),
        "op4_decontamination": lambda: decontamination.leaks(empty, bench), "op5_source_mixing": lambda: mixing.mix(empty), "op7_suffix_array_dedup": lambda: suffix_dedup.suffix_dedup(empty),
        "op8_substring_dedup": lambda: substring_dedup.substring_dedup(empty), "op10_minhash_near_dedup": lambda: minhash_dedup.near_duplicates(empty),
    }
    assert run[name]().collect() == []


# --- fingerprints ---------------------------------------------------------------------------------------------------------


def edited(texts):
    texts = [t or "" for t in texts]
    return [t[: len(t) - len(t) // 4] + texts[(i + 1) % len(texts)][: len(t) // 4] for i, t in enumerate(texts)]


@pytest.mark.parametrize("ranges", [1, 7, None])
def test_fingerprints(spark, texts, ranges):
    df = frame(spark, texts, start=10).union(frame(spark, [], 0)).repartition(3)
    got = rows_by_id(winnowing.fingerprints(df, ranges))
    for i, (t, e) in enumerate(zip(texts, edited(texts))):
        r = got[10 + i]
        assert r["n_chars"] == len(t or "") and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = {}
    for i, t in enumerate(texts):
        assert same.setdefault(t or "", got[10 + i]["fingerprint"]) == got[10 + i]["fingerprint"]
    assert got[10 + 3]["near_next"] == 1.0  # "one" follows "one"


def test_winnowing_takes_the_rightmost_and_keeps_its_guarantee(spark):
    rng = random.Random(1)
    shared = words(rng, 6)
    docs = ["a " * 12, f"{words(rng, 20)} {shared} {words(rng, 7)}", f"{words(rng, 3)} {shared} {words(rng, 31)}"]
    got = rows_by_id(winnowing.fingerprints(frame(spark, docs)))
    assert [int(x.split(":")[1]) for x in got[0]["fingerprint"].split()] == list(range(3, 10))
    marks = [{x.split(":")[0] for x in got[i]["fingerprint"].split()} for i in (1, 2)]
    assert marks[0] & marks[1]
    for i, n in ((1, 31), (2, 38)):
        at = [int(x.split(":")[1]) for x in got[i]["fingerprint"].split()]
        assert at == sorted(at) and max(np.diff([-1, *at, n])) <= winnowing.WINDOW


def kept_by_hand(text):
    """(hash, position) of each window of 4 runs of 3 words, the rightmost minimum, with the rolling recurrence."""
    full = (1 << 64) - 1
    turn = lambda x, n: (x << n | x >> 64 - n) & full
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t-\r]+", text) if w]
    if len(h) < 3:
        return None if h else []
    rolled = [turn(turn(h[0], 1) ^ h[1], 1) ^ h[2]]
    for out, new in zip(h, h[3:]):
        rolled.append(turn(rolled[-1], 1) ^ turn(out, 3) ^ new)
    top = [x >> 31 for x in rolled]
    kept = []
    for i in range(max(1, len(top) - 3)):
        window = top[i : i + 4]
        at = max(j for j, x in enumerate(window) if x == min(window))
        if (top[i + at], i + at) not in kept[-1:]:
            kept.append((top[i + at], i + at))
    return kept


def test_fingerprints_by_hand(spark, texts):
    every = [*texts, *(words(random.Random(i), 40 + i, 6) for i in range(6)), "a b c d a b c d a b"]
    got = rows_by_id(winnowing.fingerprints(frame(spark, every).withColumn("marks", F.lit(1)).withColumn("range", F.lit("x"))))
    sets = lambda shown: {x.split(":")[0] for x in shown.split()}
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    for i, (text, edit) in enumerate(zip(every, edited(every))):
        r = got[i]
        for t, shown in ((text, r["fingerprint"]), (edit, r["edited_fingerprint"])):
            kept = kept_by_hand(t or "")
            assert kept is None and len(shown.split()) == 1 or shown == " ".join(f"{x:x}:{at}" for x, at in kept), i
        assert math.isclose(r["near_edited"], dice(sets(r["fingerprint"]), sets(r["edited_fingerprint"])))
        assert math.isclose(r["near_next"], dice(sets(r["fingerprint"]), sets(got[(i + 1) % len(every)]["fingerprint"])))


def test_fingerprints_of_odd_rows(spark):
    rows = [(None, "a b c d", 1), (5, "one two three four", 1), (5, "one two three four", 1), (5, "other words are here", 1), (9, words(random.Random(1), 20_000), 1)]
    got = winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, edited int").repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t)) for i, t, _ in rows)
    assert len({r["fingerprint"] for r in got}) == 4


# --- toxicity -------------------------------------------------------------------------------------------------------------


def test_machine_learns_a_pair_that_weights_miss():
    rng = np.random.default_rng(0)
    lists, labels = [], []
    for _ in range(1200):
        x, y = rng.random(2) < 0.5
        lists.append(np.unique(np.array([7] * int(x) + [9] * int(y) + list(rng.integers(20, 40, 4)), np.int32)))
        labels.append(float(x and y))
    machine = toxicity.fit(np.array(labels), np.concatenate(lists), np.cumsum([0, *map(len, lists)]))
    assert set(machine.places) >= {7, 9}
    at = {int(p): i for i, p in enumerate(machine.places)}

    def z(*places):
        ids = [at[p] for p in places]
        return machine.bias + sum(machine.weights[i] for i in ids) + sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in itertools.combinations(ids, 2))

    assert z(7, 9) > 0 > max(z(7), z(9))


def test_scores_by_hand(spark):
    """Every score again, pair by pair, from the terms of each text."""
    rng = random.Random(21)
    texts = [f"{words(rng, 12, 60)} {'vile them' if i % 3 == 0 else ''}" for i in range(90)] + [None, "", "vile"]
    labels = np.array([float(i % 3 == 0) for i in range(90)])
    rows, places = toxicity.terms(pa.array(texts))
    lists = [np.unique(places[rows == i]).astype(np.int32) for i in range(len(texts))]
    machine = toxicity.fit(labels, np.concatenate(lists[:90]), np.cumsum([0, *map(len, lists[:90])]))
    at = {int(p): i for i, p in enumerate(machine.places)}
    assert set(at) == {int(p) for x in lists[:90] for p in x}  # no term is left out
    for x, got in zip(lists, toxicity.scores(machine, pa.array(texts))):
        ids = [at[int(p)] for p in x if int(p) in at]
        z = machine.bias + sum(float(machine.weights[i]) for i in ids) + sum(float(machine.vectors[i].astype(float) @ machine.vectors[j].astype(float)) for i, j in itertools.combinations(ids, 2))
        assert math.isclose(got, 1 / (1 + math.exp(-max(min(z, 30), -30))), rel_tol=1e-3)


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(3)
    texts = [f"{words(rng, 40)} {'Vilestem' + rng.choice(['en', 'a', 'ig']) if i % 4 == 0 else 'fine'} {words(rng, 30)}" for i in range(400)] + [None, "", "x" * 50_000]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(400)] + [(None, 1, 0), (9, None, 0)], "doc_id long, toxic int, quality int")
    got = rows_by_id(toxicity.toxicity(docs, labels))
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for i, r in got.items() if r["held_out"] and i < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[400]["score"] == got[401]["score"]
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_rows_of_one_labelled_id_are_bounded(spark, monkeypatch):
    """Equal rows count once, different texts of an id up to the sample; ids that don't repeat are all there."""
    seen = []
    whole = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda labels, terms, ends: seen.append((len(labels), int(labels.sum()))) or whole(labels, terms, ends))
    ids = [i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, int(k < 2)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    rows = [(i, f"text of {i}") for i in ids] + [(ids[0], "awful words")] * 300 + [(ids[0], f"awful words {j}") for j in range(200)]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, sample=50)
    toxicity.train(spark.createDataFrame(rows[: len(ids)], "doc_id long, text string"), labels, sample=50)
    assert seen == [(len(ids) - 2 + 50, 50), (len(ids), 2)]


def test_toxicity_without_labels(spark):
    got = toxicity.toxicity(frame(spark, ["a", None]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == 2 and len({r["score"] for r in got}) == 1


# --- shards ---------------------------------------------------------------------------------------------------------------


def test_deal_is_a_walk_round_the_ring():
    rng = random.Random(2)
    for _ in range(50):
        shards, arcs = rng.randint(1, 5), rng.randint(5, 20)
        owners = [*range(shards), *(rng.randrange(shards) for _ in range(arcs - shards))]
        rng.shuffle(owners)
        counts = [rng.randrange(9) for _ in range(arcs)]
        total = sum(counts)
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
        out = ring.deal(counts, owners, capacity)
        assert [sum(n for _, n in pieces) for pieces in out] == counts
        assert [sum(n for p in out for s, n in p if s == t) for t in range(shards)] == capacity
        for a, pieces in enumerate(out):  # a piece's shard comes in clockwise order
            way = list(dict.fromkeys(owners[(a + j) % arcs] for j in range(arcs)))
            assert [way.index(s) for s, _ in pieces] == sorted(way.index(s) for s, _ in pieces)


def test_shards(spark, texts):
    docs = frame(spark, [*texts, *["same text"] * 40]).withColumnRenamed("lang", "shard")
    rows = ring.assign_shards(docs, shards=4, nodes=8).collect()
    assert len(rows) == len(texts) + 40 and "shard" in rows[0].asDict()
    by = {}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 4
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_equal_texts_stay_together(spark, monkeypatch):
    """At most one group of equal texts parts at each cut, common texts too; rows equal in all and null ids are dealt as any."""
    monkeypatch.setattr(ring, "LEAST_COMMON", 50)
    rng = random.Random(31)
    rows = [(i, f"text {i % 300}") for i in range(3000)] + [(i, "common") for i in range(1500)] + [(7, "same row")] * 200 + [(None, None)] * 9
    rng.shuffle(rows)
    got = ring.assign_shards(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, slot int").repartition(5)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((i or 0, t or "") for i, t in rows)
    by, homes = {}, {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    cuts = sum(len(p) - 1 for p in ring.deal([1] * 512, [s for _, s in ring._points(spark, 16, 32)], [32] * 16))
    assert len(by) == 16 and sum(len(x) > 1 for x in homes.values()) <= max(32, cuts)


# --- decontamination ------------------------------------------------------------------------------------------------------


def weighted(a, b, k=5):
    def grams(x):
        n = min(k, len(x))
        return Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1))

    p, q = grams(a), grams(b)
    return sum((p & q).values()) / max(sum((p | q).values()), 1)


def test_leaks_against_all_windows(spark):
    rng = random.Random(8)
    items = [words(rng, n) for n in (3, 8, 20, 33, 50)] + ["", None]
    long = items[4].split()
    docs = [None, "", "two words"]
    for edits in (0, 1, 2, 3, 6):
        w = list(long)
        for e in range(edits):
            w[e * 8] = "edit"
        docs.append(f"{words(rng, 25)} {' '.join(w).upper()} {words(rng, 25)}")
    docs += [items[2], " ".join(items[3].split()[2:]), f"{items[0]} x {items[1]}", words(rng, 400)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for d, t in enumerate(docs):
        x = (t or "").lower().split()
        for i, item in enumerate(items):
            y = (item or "").lower().split()
            n = min(len(x), len(y))
            if y and x and max(weighted(x[s : s + n], y) for s in range(len(x) - n + 1)) >= 0.8:
                want.add((d, i))
    for lot in (100, 2):
        got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(frame(spark, docs), bench, lot).collect()}
        assert got == want and want
    clean = {r["doc_id"] for r in decontamination.drop_leaks(frame(spark, docs), bench).collect()}
    assert clean == set(range(len(docs))) - {d for d, _ in want}


def test_the_first_hit_ends_the_search(spark):
    """A template against alike items: the filter keeps what it did and stops at one window of a text."""
    rng = random.Random(3)
    template = words(rng, 40)
    items = [f"{template} item{i}" for i in range(300)]
    texts = [f"{words(rng, 5)} {template} {words(rng, 4)}" for _ in range(40)] + [words(rng, 60) for _ in range(20)] + [None, ""]
    index = decontamination.Index(list(enumerate(items)))
    every = decontamination.find(index, pa.array(texts))
    first = decontamination.find(index, pa.array(texts), first_only=True)
    assert {r[0] for r in every} == {r[0] for r in first} == set(range(40)) and len(first) == 40 and len(every) > 4000
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = decontamination.drop_leaks(frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40, 62))


def test_probing_meets_everything_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    size = decontamination.Size(9, list(range(200)), [(np.array([1], np.uint64), np.array([1]))] * 200, prints.tolist())
    near = []
    for x in prints[:60].tolist():
        for bits in (0, 5, 17, decontamination.RADIUS):
            y = x
            for b in rng.choice(64, bits, replace=False):
                y ^= 1 << int(b)
            near.append(y)
    got = set(zip(*(x.tolist() for x in size.probe(np.array(near, np.uint64)))))
    want = {(w, i, (y ^ int(p)).bit_count()) for w, y in enumerate(near) for i, p in enumerate(prints)}
    assert got == {x for x in want if x[2] <= decontamination.RADIUS} and len(got) >= 240


def test_fingerprints_of_windows(monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 7)
    rng = np.random.default_rng(2)
    shingles, starts = rng.integers(0, 1 << 63, 90, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.array([0, 1, 5, 6, 30, 79])
    for start, got in zip(starts.tolist(), decontamination.simhash(shingles, starts, 11).tolist()):
        votes = [sum(1 if int(s) >> b & 1 else -1 for s in shingles[start : start + 11]) for b in range(64)]
        assert got == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_a_phrase_that_all_items_share_costs_little():
    rng = random.Random(3)
    phrase = words(rng, 5)
    index = decontamination.Index([(i, f"{words(rng, 12, 5000)} {phrase} {words(rng, 13, 5000)}") for i in range(2000)])

    def seconds(n, filler):
        text = " ".join(phrase + (" " + words(rng, filler, 5000) if filler else "") for _ in range(n // (5 + filler)))
        began = time.process_time()
        assert decontamination.find(index, pa.array([text])) == []
        return time.process_time() - began

    for filler in (0, 3):
        assert seconds(32_000, filler) < max(12 * seconds(4000, filler), 2.0)


def test_leaks_with_odd_rows(spark):
    rng = random.Random(17)
    item, other = words(rng, 20), words(rng, 9)
    long = f"{words(rng, 15_000)} {item} {words(rng, 100)}"
    docs = spark.createDataFrame([(1, item, "d"), (1, item, "d"), (1, other, "d"), (None, item, "d"), (None, None, "d"), (5, long, "d")], "doc_id long, text string, distance string")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, item, 1), (7, other, 1), (None, other, 1), (9, None, 1)], "item_id long, text string, doc_id int")
    want = sorted([(1, 7, 0), (1, 8, 0)] * 2 + [(1, 7, 0), (1, -1, 0), (None, 7, 0), (None, 8, 0), (5, 7, 15_000), (5, 8, 15_000)], key=str)
    for lot in (4096, 2):
        got = decontamination.leaks(docs, bench, lot).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["first_word"]) for r in got), key=str) == want
        kept = decontamination.drop_leaks(docs, bench, lot)
        assert kept.collect() == [(None, None, "d")] and kept.columns == docs.columns
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == 6


# --- mixing ---------------------------------------------------------------------------------------------------------------


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    p, size, draw = rng.random(500), rng.integers(0, 300, 500), rng.random(500)
    q = mixing.fly(p, size, draw)
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert math.isclose(q.sum(), p.sum(), abs_tol=1e-6) and math.isclose((q * size).sum(), (p * size).sum(), rel_tol=1e-9)


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        share = total - sum(fixed.values())
        target = {s: share * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s: 3 * sizes[s] for s in rest if target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return fixed | target
        fixed |= over


@pytest.mark.parametrize("sizes", [{"b": 50, "a": 2, "c": 700, None: 1}, {"x": 10}, {"a": 1, "b": 1, "c": 1000, "d": 3}, {"a": 0, None: 5}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


@pytest.mark.parametrize("block", [2000, 30])
def test_mix(spark, texts, block):
    rng = random.Random(1)
    texts = [t for t in texts if block > 100 or len((t or "").split()) < 400]  # a document of half a source can't be balanced by a few
    docs = frame(spark, [*texts, *(words(rng, rng.randrange(60)) for _ in range(600)), *["twin text here"] * 3])
    old, mixing.RESERVE = mixing.RESERVE, 40
    try:
        rows, again = mixing.mix(docs, block=block).collect(), mixing.mix(docs.repartition(5), block=block).collect()
        copies = mixing.mixed_documents(docs, block=block)
        assert copies.columns == docs.columns and copies.count() == sum(r["times"] for r in rows)
    finally:
        mixing.RESERVE = old
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    sums, target = Counter(), {}
    for r in rows:
        assert 0 <= r["times"] <= 3
        sums[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
    assert [(s, t, sums[s]) for s, t in target.items() if abs(sums[s] - t) > 0.02 * t + 5] == []


def test_equal_rows_are_drawn_together(spark):
    rng = random.Random(41)
    rows = [(i, f"s{i % 2}", words(rng, rng.randrange(1, 40))) for i in range(300)] + [(7, "s0", "one two three")] * 5000 + [(None, None, None)] * 3 + [(7, "s1", "one two three")] + [(8, "s1", words(rng, 12_000))]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, text string, p double").repartition(4)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sums, target = Counter(), {}
    for r in got:
        assert 0 <= r["times"] <= 3
        sums[r["source"]] += r["times"] * r["size"]
        target[r["source"]] = r["target"]
    assert abs(sums["s0"] - target["s0"]) <= 4
    equal = [r["times"] for r in got if (r["doc_id"], r["source"]) == (7, "s0") and r["size"] == 3]
    assert max(equal) - min(equal) <= 1
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["times"] for r in got)


def test_settling_finds_the_nearest_pair():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        x, size = rng.integers(0, 2, n).astype(float), rng.integers(0, 60, n)
        words_wanted = float(rng.integers(0, 200))
        off = (x * size).sum() - words_wanted
        change = (1 - 2 * x) * size
        best = min([abs(off), *np.abs(off + change), *(abs(off + change[i] + change[j]) for i in range(n) for j in range(i))])
        got = mixing.settle(x, size, words_wanted)
        assert abs((got * size).sum() - words_wanted) <= best + 0.5


# --- urls -----------------------------------------------------------------------------------------------------------------


def splits(text):
    for n in range(len(text)):
        for cut in itertools.combinations(range(1, len(text)), n):
            at = [0, *cut, len(text)]
            yield [text[a:b] for a, b in itertools.pairwise(at)]


def test_split_is_the_likeliest():
    counts = {"a": 5, "ab": 9, "b": 2, "cab": 4, "c": 1, "abc": 3, "ca": 7}
    total = sum(counts.values())
    cost = lambda s: sum(math.log(counts[w] / total) if w in counts else -math.log(10.0 * (total + 1)) if len(w) == 1 else -math.inf for w in s)
    for text in ("abcab", "cabab", "xabc", "bbca", "zz"):
        assert math.isclose(cost(url_filter.split_words(text, counts, total)), max(map(cost, splits(text))))


def test_urls(spark):
    html = "<p>" + "cheap pills the good news blog " * 30 + "</p>"
    urls = [f"http://www.good-news{i % 4}.example.net/en/{i}" for i in range(60)] + [f"https://x.cheappills.example.net/en/{i}?q" for i in range(12)]
    urls += ["https://A.Example.ORG/es/9", "https://example.org/en/17#t", "http://b.org/", "http://shop.com/fr/1", "http://shop.com/de/x", "notorg.example", None, "://", "http://other.example.net", "http://cheap.example.net/en/3"]
    pages = spark.createDataFrame([(i, u, html, "extra") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)
    assert {got[i]["verdict"] for i in range(60)} == {"allow"} and {got[i]["verdict"] for i in range(60, 72)} == {"block"}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(72, 77)] == [("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block")]
    assert (got[72]["host"], got[72]["path"]) == ("a.example.org", "/es/9")
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (77, 78, 79))
    assert (got[80]["host"], got[80]["path"]) == ("other.example.net", "")
    assert url_filter.judge(pages.limit(0)).collect() == []


def test_seed_terms_that_no_page_has(spark):
    html = "<p>" + "the good news blog of a better win " * 30 + "</p>"
    urls = [f"http://goodnews{i % 4}.example.net/en/{i}" for i in range(60)]
    urls += [f"http://{h}.example.com/offer" for h in ("free-bets", "casinowin", "luckyloans", "betting", "pill", "gamblewin") for _ in range(4)]
    pages = spark.createDataFrame([(i, u, html) for i, u in enumerate([*urls, "http://better-news.example.net/en/5"])], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert {got[i] for i in (*range(60), 84)} == {"allow"} and {got[i] for i in range(60, 84)} == {"block"}


def test_scores_of_urls_again(spark):
    """Every score by brute force; a url without any seed term is blocked for what goes with such terms, and for its page's words."""
    plain, bad = "<p>" + "the good news blog lucky win free story " * 20 + "</p>", "<p>" + "poker and casino win " * 20 + "</p>"
    rows = [(f"http://goodnews{i % 5}.example.net/en/{i}", plain) for i in range(50)] + [(f"http://{h}.example.com/", plain) for h in ("casinoluckywin", "luckypoker", "winbingo", "freebets") for _ in range(8)]
    rows += [("http://quietname.example.com/", bad), ("http://quietname.example.com/x", plain), ("http://luckywin.example.com/", plain), (None, None), ("http://good-news1.example.net/en/3", None)]
    got = url_filter.judge(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")).collect()
    forms = {f for s in url_filter.SEEDS for f in url_filter.inflections(s)}
    word_lists = [re.findall("[a-z]+", re.sub("<[^>]*>", " ", h or "").lower()) for _, h in rows]
    counts = Counter(w for x in word_lists for w in x) + Counter(forms)
    total = sum(counts.values())
    b, g, urls = Counter(url_filter.SEEDS), Counter(), Counter()
    pages = {}
    for (url, _), x in zip(rows, word_lists):
        host, path = re.match("[a-z]+://([^/]*)(.*)", url).groups() if url else ("", "")
        tokens = [w for c in re.findall("[a-z]+", host) for w in url_filter.split_words(c, counts, total)] + ["0" if t.isdigit() else t for t in re.findall("[a-z0-9]+", path)]
        marked = sum(w in forms for w in x) > 0.02 * len(x) and len(forms & set(x)) > 1
        pages.setdefault((host, path), [tokens, False, 0])
        pages[host, path][1] |= marked or bool(forms & set(tokens))
        pages[host, path][2] += 1
    for tokens, is_bad, times in pages.values():
        urls[is_bad] += times
        for t in tokens:
            (b if is_bad else g)[t] += times
    kinds, nb, ng = len(set(b) | set(g)), sum(b.values()), sum(g.values())
    for r in got:
        want = sum(math.log((b[t] + 1) / (nb + kinds)) - math.log((g[t] + 1) / (ng + kinds)) for t in pages[r["host"], r["path"]][0]) + math.log((urls[True] + 1) / (urls[False] + 1))
        assert math.isclose(r["score"], want, rel_tol=1e-9, abs_tol=1e-9), r
        assert r["verdict"] == ("block" if want > 0 else "allow")
    verdict = {rows[r["page_id"]][0]: r["verdict"] for r in got}
    assert verdict["http://luckywin.example.com/"] == "block" and verdict["http://good-news1.example.net/en/3"] == "allow"


def test_inflections():
    assert {"bets", "betting", "betted"} <= url_filter.inflections("bet") and "better" not in url_filter.inflections("bet")
    assert {"loans", "loaned", "loaning"} <= url_filter.inflections("loan") and "pill" in url_filter.inflections("pills") and "gamble" in url_filter.inflections("gambling")
    assert {"casinos", "spamming", "sexes"} <= {f for s in url_filter.SEEDS for f in url_filter.inflections(s)}


# --- repeats --------------------------------------------------------------------------------------------------------------


def brute(units_of, texts, size, glue):
    docs = [units_of(t) for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[tuple(d[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(glue([u for u, g in zip(d, gone) if not g])).hexdigest()))
    return out


def repeating(rng):
    """Texts that share passages, copies with edits, and periodic runs."""
    passages = [words(rng, n, 50) for n in (36, 40, 70, 120)]
    out = []
    for _ in range(30):
        parts = [words(rng, rng.randrange(60), 50), rng.choice(passages), words(rng, rng.randrange(30), 50)]
        if rng.random() < 0.3:
            w = parts[1].split()
            w[rng.randrange(len(w))] = "edit"
            parts[1] = " ".join(w)
        out.append(" ".join(parts))
    return [*out, "ab cd " * 60, "z" * 900, out[3], out[3]]


@pytest.mark.parametrize("part", [None, 1, 3])
def test_substring_dedup(spark, texts, part):
    every = [*texts, *repeating(random.Random(6))]
    got = rows_by_id(substring_dedup.substring_dedup(frame(spark, every), part))
    want = brute(lambda t: (t or "").encode().split(), every, 35, b" ".join)
    for i, (n, gone, _, sha) in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, sha), i


@pytest.mark.parametrize("part", [None, 1, 3])
def test_suffix_dedup(spark, texts, part):
    every = [*texts, *repeating(random.Random(7))]
    got = rows_by_id(suffix_dedup.suffix_dedup(frame(spark, every), part))
    want = brute(lambda t: (t or "").encode(), every, 200, bytes)
    for i, w in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i


def odd_rows(rng):
    """Rows equal in id and text, ids shared by different texts, null ids, a text over 50 KB, columns with names used inside."""
    passage, long = words(rng, 60, 50), words(rng, 12_000, 300)
    rows = [(1, passage)] * 3 + [(1, f"x {passage} y"), (2, "one two"), (2, "one two"), (None, f"{passage} z"), (None, None), (3, long), (4, f"{words(rng, 50)} {long[500:9000]}"), (4, "ab " * 20_000)]
    return [(i, t, "k", 7, "s") for i, t in rows], "doc_id long, text string, k1 string, live int, marks string"


@pytest.mark.parametrize("part", [None, 2])
def test_repeats_with_odd_rows(spark, part):
    rows, schema = odd_rows(random.Random(12))
    docs = spark.createDataFrame(rows, schema).repartition(3)
    sha = lambda got, *c: sorted((tuple(r[x] for x in ("doc_id", *c)) for r in got.collect()), key=str)
    want = brute(lambda t: (t or "").encode(), [r[1] for r in rows], 200, bytes)
    assert sha(suffix_dedup.suffix_dedup(docs, part), "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
    want = brute(lambda t: (t or "").encode().split(), [r[1] for r in rows], 35, b" ".join)
    assert sha(substring_dedup.substring_dedup(docs, part), "n_words", "n_removed", "kept_sha256") == sorted(((r[0], w[0], w[1], w[3]) for r, w in zip(rows, want)), key=str)


def test_equal_rows_cost_as_much_as_they_hold(spark):
    """Ten thousand equal rows of 300 words, and rows equal in text only."""
    text = words(random.Random(13), 300)
    docs = spark.range(10_000).selectExpr("if(id % 2 = 0, 7, id) as doc_id", "cast(null as string) as text").fillna({"text": text})
    for run, cols in ((suffix_dedup.suffix_dedup, ("n_bytes", "n_removed")), (substring_dedup.substring_dedup, ("n_words", "n_removed"))):
        got = run(docs).groupBy(*cols).count().collect()
        assert len(got) == 1 and got[0][0] == got[0][1] and got[0]["count"] == 10_000


def test_suffix_array_and_prefixes():
    rng = random.Random(9)
    for text in ("banana", "aaaaaaaaaaaaaaaaaaaaaaaa", "".join(rng.choice("ab") for _ in range(300)), "abcabcabcabcabcabcxabcabcabc"):
        codes = np.array([ord(c) for c in text], np.int64)
        order = suffix_dedup.suffix_array(codes)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = suffix_dedup.common_prefixes(codes, order)
        for r in range(1, len(text)):
            a, b = text[order[r - 1] :], text[order[r] :]
            assert shared[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_near_copies_packed_one_after_another(seed):
    """Prefixes shared across the end of a packed string neither hide a repeat nor make one up."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd") for _ in range(336)).encode() for _ in range(2)]
    strings = []
    while len(strings) < 60:
        s, at = rng.choice(base), rng.randrange(336)
        s = s[:at] + rng.choice([b"x", b"y", b"z"]) + s[at + 1 :]
        strings += [s] if s not in strings else []
    seen = Counter(s[i : i + 200] for s in strings for i in range(137))
    shard = suffix_dedup.Shard([(0, 0, 1, j, 137, 1, s) for j, s in enumerate(strings)])
    assert shard.again[shard.start].tolist() == [seen[s[i : i + 200]] > 1 for s in strings for i in range(137)]


@pytest.mark.parametrize("limit", [1, 600, 5000, 1 << 20])
def test_shards_merge_by_binary_search(limit):
    rng = random.Random(limit)
    pool = ["".join(rng.choice("abcd") for _ in range(300)).encode() for _ in range(4)]
    rows = []
    for j in range(40):
        anchor = j // 8
        s = pool[anchor % 4][: rng.randrange(205, 270)] if rng.random() < 0.6 else "".join(rng.choice("abcd") for _ in range(250)).encode()
        rows.append((anchor, 0, 1, j, len(s) - 199, 1 + (j % 13 == 0), s))
    seen = {a: Counter() for a in range(5)}
    for a, _, _, _, n, times, s in rows:
        for i in range(n):
            seen[a][s[i : i + 200]] += times
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], repeats.PACKED)
    got = {}
    for out in suffix_dedup.count_bytes(iter([batch]), limit):
        got |= {c: m for c, m in zip(out.column(2).to_pylist(), out.column(3).to_pylist())}
    for a, _, _, c, n, _, s in rows:
        mask = np.unpackbits(np.frombuffer(got[c], np.uint8))[:n]
        for i in range(n):
            # a window of another anchor's string may be marked too; a repeat within the anchor must be
            assert mask[i] or seen[a][s[i : i + 200]] == 1
            assert not mask[i] or sum(seen[b][s[i : i + 200]] for b in seen) > 1


def test_long_texts_are_anchored_in_parts(monkeypatch):
    unit = repeats.Unit(words=False, length=20, gram=8)
    data = np.frombuffer(("".join(random.Random(1).choice("abcdef") for _ in range(3000))).encode(), np.uint8)
    whole = repeats.runs_of(repeats.byte_units(data), np.array([0, 1000, 3000]), unit)
    monkeypatch.setattr(repeats, "STEP", 170)
    parts = repeats.runs_of(repeats.byte_units(data), np.array([0, 1000, 3000]), unit)
    spread = lambda runs: [(d, s + i, a) for d, s, n, a in zip(*(x.tolist() for x in runs)) for i in range(n)]
    assert spread(whole) == spread(parts) and len(spread(whole)) == 981 + 1981


# --- html -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "source,want",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<title>no</title><h1>T</h1><p>a <b>b</b>\n c<p>d<br>e", "T\n\na b c\n\nd\ne"),
        ("<ul><li>x<li>y<ol><li>1<li>2</ol></ul>z", "- x\n- y\n  1. 1\n  2. 2\n\nz"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("a<script>if (x < 1) { y = '<p>' }</script>b<style>p{}</style><!-- c --><div hidden>d</div><div style='DISPLAY: none'><p>e</div>f", "abf"),
        ("<pre>  x\n    y</pre>", "  x\n    y"),
        ("<dl><dt>t<dd>d</dl>", "t\n    d"),
        ("<p>unclosed <b>bold <i>both</p><p>next < 3 & more", "unclosed bold both\n\nnext < 3 & more"),
        ("<div>" * 5000 + "deep", "deep"),
        ("</p></div>x", "x"),
        ("<script>never ends", ""),
    ],
)
def test_render(source, want):
    assert html_text.render(source) == want


@pytest.mark.parametrize(
    "source,want",
    [
        ('<p title="a hidden gem">a</p><p class="nav hidden md">b</p><p data-style="display:none">c</p>', "a\n\nb\n\nc"),
        ("<p>a<p hidden>b<p HIDDEN=''>c<p id=x hidden title='y'>d<p style='color:red; visibility : hidden'>e<p style=display:none>f", "a"),
        ("<html><head><title>t</title><meta charset=x><p>a<p>b", "a\n\nb"),
        ("<head><script>x</script>  \n a <b>b</b>", "a b"),
        ("<head><title>t</title></head>a", "a"),
        ("<head><noscript><img>x</noscript><style>p{}</style><body>a", "a"),
        ("<svg><title>t</title><desc>d</desc><defs><text>x</text></defs><text>one</text><text>two</text></svg> <math><mi>a</mi><mo>+</mo><mi>b</mi></math>", "one two a+b"),
        ("a<svg><title/><path d='none'/></svg>b", "ab"),
    ],
)
def test_all_visible_text(source, want):
    assert html_text.render(source) == want


@pytest.mark.parametrize(
    "source,want",
    [
        ('<a b="x>y">a</a><p title=">">b</p>', "a\n\nb"),
        ('<p class=x"y>a</p>b', "a\n\nb"),
        ('a<b title="never closed>c</b> d', "ac d"),
        ("a<b c", "a"),
        ("a<!-- b", "a"),
        ("a</ b>c<?d?>e<!f>g", "aceg"),
        ("<pre>\n x</pre>", " x"),
        ("<table><tr><td colspan=2>all of them<td>c<tr><td>a<td>b<td>d</table>", "all of them  c\na  b         d"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b</table>", "r  a\n   b"),
        ("<div/>a<svg/>b<p/>c", "ab\n\nc"),
        ("<table><tr><td><b>x</td></b></i><td>y</table>z", "x  y\n\nz"),
    ],
)
def test_broken_and_spanning_markup(source, want):
    assert html_text.render(source) == want


@pytest.mark.parametrize(
    "unit", ['<a "', '<a b="', "<div>", "</b>", "<i></u>", "<!", "<", "<p>x", "<ul><li>x", "<table><tr><td>x", "<td colspan=1000>x", "<tr><td rowspan=9999>x", "<svg><desc>", '<a b="x" ', "</title   ", "<b>x</b> "]
)
def test_time_grows_with_the_page(unit):
    def seconds(size):
        source = "<table>" + unit * (size // len(unit))
        began = time.process_time()
        html_text.render(source)
        return time.process_time() - began

    assert min(seconds(400_000) for _ in range(2)) < max(12 * min(seconds(50_000) for _ in range(3)), 1.0)


@pytest.mark.parametrize(
    "source,want",
    [
        ("<video>old<p>browser</p></video>a<canvas>none</canvas><audio src=x>no</audio>b", "ab"),
        ("<dialog>closed</dialog><dialog open>seen</dialog>", "seen"),
        ("<details><summary>head</summary>body<p>more</details><details open><summary>h</summary>b</details>", "head\nh\nb"),
        ("<p style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</p>", "yes"),
        ("<ol start=5><li>a<li>b<li value=9>c<li>d</ol>", "5. a\n6. b\n9. c\n10. d"),
        ("<table><tr><td rowspan=0>r<td>a<tr><td>b<tr><td>c</table>", "r  a\n   b\n   c"),
        ("a</p>b</br>c", "a\n\nb\nc"),
        ("<table><tfoot><tr><td>f</tfoot><tbody><tr><td>b</tbody><thead><tr><td>h</thead></table>", "h\nb\nf"),
    ],
)
def test_text_as_browsers_show_it(source, want):
    assert html_text.render(source) == want


@pytest.mark.parametrize("seed", range(20))
def test_places_of_cells(seed):
    """Against a grid: a cell takes the first columns that nothing above stands in."""
    rng = random.Random(seed)
    rows = [[("x", rng.choice([1, 1, 2, 5]), rng.choice([1, 1, 2, 3, 150, 65_534])) for _ in range(rng.randrange(6))] for _ in range(rng.choice([5, 200]))]
    until: dict[int, int] = {}  # column -> row from which it is free
    for r, (row, line) in enumerate(zip(rows, html_text.places_of(rows))):
        at, new = 0, []
        for (_, wide, high), place in zip(row, line):
            while until.get(at, 0) > r:
                at += 1
            assert place == (at, at + wide)
            new += [(c, r + high) for c in range(at, at + wide)]
            at += wide
        for c, last in new:
            if until.get(c, 0) <= r:
                until[c] = last


def test_long_rows_of_spans_are_quick():
    """1 MB of cells over two columns above a row of cells, and of tall cells above short rows."""
    wide = "<table><tr>" + "<td colspan=2>x" * 33_000 + "<tr>" + "<td>y" * 99_000 + "</table>"
    tall = "<table><tr>" + "<td rowspan=9999>x" * 25_000 + "<tr><td>y" * 50_000 + "</table>"
    for source in (wide, tall):
        began = time.process_time()
        html_text.render(source)
        assert time.process_time() - began < 12


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>é", "u", "x"), (None, None, None, "y"), (1, "<p>é", "u", "x")], "page_id long, html string, url string, text string")
    assert sorted(html_text.extract(pages).collect(), key=str) == sorted([(1, "é", 1), (1, "é", 1), (None, "", 0)], key=str)


# --- near duplicates ------------------------------------------------------------------------------------------------------


def brute_near(texts, k, percent):
    sets = []
    for t in texts:
        w = [x.decode() for x in "".join(c.lower() if c < "\x80" else c for c in (t or "")).encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("k,part", [(2, 4096), (2, 3), (5, 4096)])
def test_near_duplicates(spark, texts, k, part):
    rng = random.Random(4)
    base = words(rng, 80).split()
    group = []
    for _ in range(60):  # copies of one text with many or few edits: links form chains and gaps
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(500)}"
        group.append(" ".join(w))
    every = [*texts, *group]
    got = rows_by_id(minhash_dedup.near_duplicates(frame(spark, every), k, 80, part))
    for i, (n, component) in enumerate(brute_near(every, k, 80)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, component, component == i), i


@pytest.mark.parametrize("seed", range(12))
def test_links_of_a_bucket(seed):
    """Templates, chains of edits, subsets: what is joined and what is not, as all pairs say."""
    rng = random.Random(seed)
    template = rng.sample(range(10**6), rng.choice([0, 30, 80]))
    base, sets = rng.sample(range(10**6), 40), []
    for i in range(rng.choice([3, 40, 90])):
        kind = rng.random()
        own = set(rng.sample(range(10**6), rng.randrange(0, 40))) if kind < 0.5 else set(rng.sample(base, rng.randrange(30, 41))) | set(rng.sample(range(10**6), rng.randrange(5)))
        sets.append(own | set(template if rng.random() < 0.9 else template[:40]) or {i})
    percent, lead = rng.choice([50, 80, 95]), sets[0]
    component = np.array([rng.randrange(len(sets)) if rng.random() < 0.4 else 1000 + i for i in range(len(sets))])
    main = Counter(component.tolist()).most_common(1)[0][0]
    found = minhash_dedup.cross_links(component, component != main, np.array([len(s) for s in sets]), [np.array(sorted(lead ^ s), np.int64) for s in sets], percent)

    def groups(links):
        root = {c: c for c in set(component.tolist())}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        for x, y in links:
            root[find(x)] = find(y)
        return {frozenset(c for c in root if find(c) == r) for r in map(find, root)}

    links = [(int(component[i]), int(component[j])) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert groups(found) == groups(links) and set(found) <= {p for x, y in links for p in ((x, y), (y, x))}


def test_a_bucket_of_many_templated_members_is_linear():
    """30 shingles of their own each beside a common template of 200: nothing links, and twice as many cost about twice."""
    took = []
    for count in (4000, 8000, 16_000):
        rng = np.random.default_rng(count)
        own = rng.integers(1 << 20, 1 << 40, (count, 30))
        diffs = [np.unique(np.concatenate([own[0], x])) if i else np.empty(0, np.int64) for i, x in enumerate(own)]
        n = np.full(count, 230)
        began = time.process_time()
        assert minhash_dedup.cross_links(np.arange(count), np.arange(count) > 0, n, diffs, 80) == []
        took.append(time.process_time() - began)
    assert took[2] < 8 * took[0] + 1


def test_near_duplicates_with_odd_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (5, "quite another text than that"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, 2).collect()), key=str)
    assert got == sorted([(5, 6, 3, False), (5, 6, 3, False), (None, 6, None, True), (3, 6, 3, True), (5, 4, 5, True), (None, 0, None, True)], key=str)


def test_ids_shared_by_different_texts(spark):
    """Each text has its own component; of a group one row stays, an unrelated text with the same id too."""
    near = "a b c d e f g h i j k l m n o p q r s t"
    rows = [(3, near), (5, near + " u"), (5, "quite another text than that one is"), (7, "quite another text than that one is"), (5, "Quite  another text than that one is"), (3, near), (2, None), (2, " "), (2, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, t1 int, component_id string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == sorted([(3, 16, 3, True)] * 2 + [(5, 17, 3, False)] + [(5, 3, 5, True)] * 2 + [(7, 3, 5, False)] + [(2, 0, 2, True)] * 3)
    kept = [(r["doc_id"], (r["text"] or "").lower().split()) for r in minhash_dedup.keep_one(docs).collect()]
    assert sorted(kept) == sorted([(3, near.split()), (5, "quite another text than that one is".split()), (2, [])] + [(2, [])])


def test_equal_rows_are_one_class(spark):
    text = words(random.Random(14), 200)
    docs = spark.range(20_000).selectExpr("if(id % 2 = 0, 7, id + 10) as doc_id", f"concat('{text}', if(id % 4 = 1, ' end', '')) as text")
    got = minhash_dedup.near_duplicates(docs).groupBy("component_id", "kept").count().collect()
    assert sorted((r["component_id"], r["kept"], r["count"]) for r in got) == [(7, False, 10_000), (7, True, 10_000)]
    assert minhash_dedup.keep_one(docs).count() == 1


# --- pipeline -------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, step in corpus_pipeline.STAGES:
        before, kept = kept, corpus_pipeline.stage(step(spark, kept, SMALL))
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, Counter(r["doc_id"] for r in kept.collect())
        if name == "toxicity":
            scored = toxicity.toxicity(before, labels).collect()
            assert set(new) == {r["doc_id"] for r in scored if not r["predicted"]}
        elif name == "near_dedup":
            ids = sorted(old)
            assert set(new) == {ids[i] for i, (_, c) in enumerate(brute_near([old[x] for x in ids], 5, 80)) if c == i}
        elif name == "decontamination":
            found = decontamination.leaks(before, spark.read.parquet(f"{SMALL}/benchmark.parquet"))
            assert set(new) == set(old) - {r["doc_id"] for r in found.collect()}
        elif name == "mixing":
            assert new == Counter({r["doc_id"]: r["times"] for r in mixing.mix(before).collect() if r["times"]})
        else:
            assert sum(new.values()) == before.count() and set(columns) <= set(kept.columns)
        if name != "sharding":
            assert kept.columns == columns


def test_stages_on_odd_rows(spark):
    """Null ids, texts and sources, repeated rows, clashing columns, a text over 50 KB; each stage on an empty table too."""
    import corpus_pipeline

    rng = random.Random(51)
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    long = words(rng, 12_000)
    rows = [(1, long), (2, f"{long} more"), (3, item), (3, item), (4, None), (None, None), (None, "no id here at all"), (5, "twin"), (5, "twin"), (6, ""), (7, words(rng, 40)), (7, words(rng, 40))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", 1, "x", 0, 1.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, shard string, t1 int, p double")
    count = {name: step(spark, docs, SMALL).count() for name, step in corpus_pipeline.STAGES}
    assert count["toxicity"] <= 12 and count["sharding"] == 12
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), len(r["text"] or "")) for r in kept.collect()) == sorted([(1, len(long)), (3, len(item)), (4, 0), (0, 0), (0, 17), (5, 4), (6, 0), (7, len(rows[10][1])), (7, len(rows[11][1]))])
    assert sorted((r["doc_id"] or 0) for r in corpus_pipeline.decontamination(spark, docs, SMALL).collect()) == [0, 0, 1, 2, 4, 5, 5, 6, 7, 7]
    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, SMALL).collect())
    assert all(n <= 3 * sum(i == d for i, _ in rows) for d, n in mixed.items())
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SMALL).collect() == [], name


def test_operators_on_odd_rows(spark):
    """Scores, mixes and urls of null ids, equal rows and clashing columns; an empty table of pages."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    rows = [(i, "vile word" if i % 2 else "kind word") for i in range(60)] + [(None, "vile word"), (5, "vile word"), (5, "vile word"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 64 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_components(spark):
    from contrail.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
