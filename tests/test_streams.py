"""Streams of growing logs: bytes and lines, order of triggers, exact pairs, bounded state."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.operators import replay as r
from contrail.sources import live_logs
from contrail.sources.events import ENVELOPE, append_events, hidden_folders, list_sessions, read_session_metadata
from contrail.streaming import ordered as o
from contrail.streaming import sessions as st


def line(session, sequence, kind="llm.request", payload=None, at=None):
    stamp = f"2024-01-01T{(at or sequence) // 3600:02d}:{(at or sequence) // 60 % 60:02d}:{(at or sequence) % 60:02d}Z"
    return json.dumps({"event_id": f"{session}-{sequence}", "session_id": session, "timestamp": stamp, "sequence": sequence, "category": kind.split(".")[0], "event_type": kind, "source": "x", "payload": payload or {}})


class Logs:
    def __init__(self, spark, folder):
        self.spark, self.base, self.folder = spark, folder / "base", folder

    def add(self, session, text, name="events.jsonl"):
        (self.base / session).mkdir(parents=True, exist_ok=True)
        with open(self.base / session / name, "ab") as f:
            f.write(text.encode())

    def read(self, **more):
        stream = live_logs.stream_events(self.spark, str(self.base), str(self.folder / "positions"), **more)
        out = st.run_available(stream, str(self.folder / "out"), str(self.folder / "check"))
        return sorted((x["session_id"], x["sequence"]) for x in out.collect())


@pytest.fixture
def logs(spark, tmp_path):
    return Logs(spark, tmp_path)


def test_lines_added_between_triggers_come_once(logs):
    logs.add("a", line("a", 1) + "\n" + line("a", 2)[:40])
    assert logs.read() == [("a", 1)]  # the started line waits
    logs.add("a", line("a", 2)[40:] + "\n\n  \nbroken{\n" + line("a", 3) + "\r\n" + line("a", 4))
    logs.add("b", line("b", 1) + "\n")
    assert logs.read() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert logs.read() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    logs.add("a", "\n")
    assert logs.read()[3] == ("a", 4)


def test_hidden_sessions(logs):
    logs.add("seen", line("seen", 1) + "\n")
    logs.add("hidden", line("hidden", 1) + "\n")
    logs.add("hidden", "", ".hidden")
    logs.add(".dot", line("dot", 1) + "\n")
    logs.add("other", line("other", 1) + "\n", "notes.txt")
    assert logs.read() == [("seen", 1)]
    logs.add("seen", "", ".hidden")  # watched already
    logs.add("seen", line("seen", 2) + "\n")
    logs.add("hidden", line("hidden", 2) + "\n")
    assert logs.read() == [("seen", 1), ("seen", 2)]
    (logs.base / "hidden" / ".hidden").unlink()
    assert logs.read() == [("hidden", 1), ("hidden", 2), ("seen", 1), ("seen", 2)]


def test_no_base_yet(logs):
    assert logs.read() == []
    logs.add("a", line("a", 1) + "\n")
    assert logs.read() == [("a", 1)]


def test_bounded_triggers_read_everything_in_turn(logs):
    for s in "abc":
        logs.add(s, "".join(line(s, i) + "\n" for i in range(1, 6)))
    assert logs.read(max_bytes=700) == [(s, i) for s in "abc" for i in range(1, 6)]
    assert len(list((logs.folder / "check" / "commits").glob("[0-9]*"))) > 3


def test_spans_share_lines_out(tmp_path, monkeypatch):
    """However a file is cut, each line belongs to the span that holds its end."""
    rng = random.Random(4)
    lines = [bytes(rng.choices(b"xyz\r\xff", k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(60)]
    path = tmp_path / "f"
    path.write_bytes(b"\n".join(lines) + b"\nunfinished")
    own, _ = live_logs.file_system(str(path))
    for step in (1, 7, 64, 10**6):
        monkeypatch.setattr(live_logs, "STEP", step)
        for _ in range(5):
            cuts = sorted({0, path.stat().st_size, *(rng.randrange(path.stat().st_size) for _ in range(rng.randrange(9)))})
            got = [x for a, b in zip(cuts, cuts[1:]) for block in live_logs.lines_of(own, live_logs.Span(str(path), a, b)) for x in block]
            assert got == lines


def test_small_files_share_a_task(tmp_path):
    """A task for each file was one for each session."""
    for i in range(3000):
        (tmp_path / "base" / f"s{i}").mkdir(parents=True)
        (tmp_path / "base" / f"s{i}" / "events.jsonl").write_text(f"{i}\n")
    reader = live_logs.LineReader({"path": str(tmp_path / "base"), "positions": str(tmp_path / "positions")})
    parts = reader.partitions({"n": 0}, reader.latestOffset())
    assert len(parts) < 10
    assert sorted(int(x) for part in parts for batch in reader.read(part) for x in batch.column(0).to_pylist()) == list(range(3000))


def test_a_span_of_a_large_file_is_a_task():
    spans = [live_logs.Span("a", i * live_logs.SPLIT, (i + 1) * live_logs.SPLIT) for i in range(3)]
    assert [x.spans for x in live_logs.packed_spans(spans)] == [[x] for x in spans]


@pytest.mark.parametrize("folders", [None, 4])
def test_appended_events_lie_in_few_files(spark, tmp_path, folders):
    """A session's events lie in one folder, whose number of files doesn't grow with the tasks that made the rows."""
    lines = [line(f"s{i % 12}", i // 12 + 1) for i in range(240)]
    rows = batch(spark, lines).repartition(16)
    append_events(rows.withColumnRenamed("sequence", "pos"), rows, str(tmp_path / "log"), folders)
    files = list((tmp_path / "log").glob("*/*.json"))
    assert len(files) == len({f.parent for f in files}) <= (folders or 12)
    back = spark.read.schema("session_id string, sequence long").json(str(tmp_path / "log")).select("session_id", "sequence")
    assert sorted(map(tuple, back.collect())) == sorted((f"s{i}", j) for i in range(12) for j in range(21, 41))


def test_snapshots_are_bounded(logs):
    for i in range(1, 6):
        logs.add("a", line("a", i) + "\n")
        logs.read()
    assert len(list((logs.folder / "positions").glob("*.json"))) <= 2


def test_hidden_metadata(spark, tmp_path):
    for name, mark in (("one", False), ("two", True)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"session_id": name}))
        if mark:
            (tmp_path / name / ".hidden").touch()
    assert hidden_folders(spark, str(tmp_path)) == ["two"] and hidden_folders(spark, str(tmp_path / "none")) == []
    found = read_session_metadata(spark, str(tmp_path))
    assert [x["session_id"] for x in list_sessions(found).collect()] == ["one"]
    assert [x["session_id"] for x in list_sessions(found, include_hidden=True).collect()] == ["one", "two"]


# --- keyed state ----------------------------------------------------------------------------------------------------------


def triggers(spark, tmp_path, parts, transform, mode):
    """Each part of JSON lines in a trigger of its own; the rows."""
    for i, part in enumerate(parts):
        path = tmp_path / "log" / "s" / f"{i}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(x + "\n" for x in part))
        stream = live_logs.stream_events(spark, str(tmp_path / "log"), str(tmp_path / "positions"), "*.jsonl")
        out = st.run_available(transform(stream), str(tmp_path / "out"), str(tmp_path / "check"), mode)
    return out


def shuffled(lines, parts, seed, near=10**9):
    """Dealt over triggers; a line is at most `near` places from its own."""
    rng = random.Random(seed)
    order = sorted(range(len(lines)), key=lambda i: i + rng.uniform(0, near))
    size = -(-len(lines) // parts)
    return [[lines[i] for i in order[a : a + size]] for a in range(0, len(lines), size)]


def batch(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", ENVELOPE).alias("e")).select("e.*")


@pytest.fixture(scope="module")
def calls():
    rng = random.Random(6)
    out = []
    for i in range(1, 160):
        session = rng.choice("ab")
        kind = rng.choice(["llm.request", "llm.response", "llm.response", "state.update"])
        body = {"request_id": f"r{rng.randrange(4)}", "model": f"m{i % 3}", "usage": {"total_tokens": i}} if rng.random() < 0.9 else {}
        out.append(line(session, i, kind, body, at=10 * (i // 2) + 1))  # two events share a time
    return out


def test_pairs_of_shuffled_triggers_are_the_batch_pairs(spark, tmp_path, calls):
    want = sorted(map(tuple, r.pair_llm_calls(batch(spark, calls)).select("session_id", "request_id", "first_sequence", "second_sequence", "seconds", "model", "tokens").collect()))
    parts = [*shuffled(calls, 4, 1, near=40), [line("clock", 1, "llm.request", {"request_id": "tick"}, at=80_000)]]
    got = triggers(spark, tmp_path, parts, o.stream_llm_pairs, "append")
    assert got.columns == ["session_id", "request_id", "first_sequence", "second_sequence", "seconds", "model", "tokens"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_pairs_wait_for_the_watermark(spark, tmp_path, calls):
    """Without a later event nothing is final yet."""
    assert triggers(spark, tmp_path, [calls[:50]], o.stream_llm_pairs, "append").count() == 0


def test_calls_share_state(spark, tmp_path):
    """An id of its own state cost calls to the state store; ids share slots, so state is written once for many of them."""
    ids = 3000
    path = tmp_path / "log" / "s" / "0.jsonl"
    path.parent.mkdir(parents=True)
    kinds = [("llm.request", 1), ("llm.response", 2)]
    path.write_text("".join(line("a", 2 * i + j, kind, {"request_id": f"r{i}"}, at=j) + "\n" for i in range(ids) for kind, j in kinds) + line("clock", 1, "llm.request", {"request_id": "tick"}, at=80_000) + "\n")
    stream = o.stream_llm_pairs(live_logs.stream_events(spark, str(tmp_path / "log"), str(tmp_path / "positions"), "*.jsonl"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert max(x.stateOperators[0].numRowsUpdated for x in query.recentProgress) < ids
    got = spark.read.parquet(str(tmp_path / "out")).select("session_id", "request_id", "first_sequence", "second_sequence", "seconds", "model", "tokens")
    assert sorted(map(tuple, got.collect())) == sorted(("a", f"r{i}", 2 * i + 1, 2 * i + 2, 1.0, None, 0) for i in range(ids))


class Held:
    """A list state (or, with one row, a value state)."""

    def __init__(self):
        self.rows = []

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def appendValue(self, row):
        self.rows = [*self.rows, row]

    def appendList(self, rows):
        self.rows = [*self.rows, *rows]


class One:
    row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class Handle:
    def __init__(self):
        self.timers, self.state = set(), {}

    def getListState(self, name, schema):
        return self.state.setdefault(name, Held())

    def getValueState(self, name, schema):
        return self.state.setdefault(name, One())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def pairs_id_by_id(triggers, delay, idle):
    """What each id gives out alone: held until the watermark has passed, folded by sequence, forgotten idle ms after its last event. The triggers without late events and the pairs."""
    ids, out, taken, reached = {}, [], [], 0
    for rows in triggers:
        taken.append([r for r in rows if r["us"] > reached])
        for r in taken[-1]:
            ids.setdefault((r["session_id"], r["request_id"]), {"held": [], "asked": None, "last": 0})["held"].append(r)
        for key, x in ids.items():
            for r in sorted((r for r in x["held"] if r["us"] <= reached), key=lambda r: r["sequence"]):
                if r["response"] and x["asked"]:
                    out.append((*key, x["asked"]["sequence"], r["sequence"], (r["us"] - x["asked"]["us"]) / 1e6, x["asked"]["value"], int(r["value"])))
                x["asked"], x["last"] = None if r["response"] else r, max(x["last"], r["us"])
            x["held"] = [r for r in x["held"] if r["us"] > reached]
            if not x["held"] and x["last"] + idle * 1000 <= reached:
                x["asked"] = None
        reached = max(reached, max(r["us"] for r in rows) // 1000 * 1000 - delay * 1000)
    return taken, out


@pytest.mark.parametrize("seed", range(30))
def test_a_slot_gives_out_the_pairs_of_its_ids(monkeypatch, seed):
    monkeypatch.setattr(o, "CHUNK", 3)
    rng = random.Random(seed)
    rows, us = [], 1_000_000
    for i in range(300):
        us += rng.choice([0, 1, 700, 5_000, 2_000_000])
        asks = rng.random() < 0.5
        value = rng.choice(["m0", "m1", None]) if asks else str(2**53 + 2 * i + 1)
        rows.append({"session_id": rng.choice("ab"), "request_id": f"r{rng.randrange(5)}", "us": us, "sequence": i, "response": not asks, "value": value})
    order = sorted(rows, key=lambda r: r["sequence"] + rng.uniform(0, 12))
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(40))})
    end = [[{"session_id": "clock", "request_id": "tick", "us": us + 10**9 + i, "sequence": i, "response": False, "value": None}] for i in range(3)]
    delay, idle = rng.choice([3_000, 30_000]), rng.choice([2_000, 20_000, 10**7])
    taken, want = pairs_id_by_id([*(order[a:b] for a, b in zip(cuts, cuts[1:])), *end], delay, idle)
    assert len(want) > 20
    slot, handle, got, reached = o.CallPairs(idle), Handle(), [], 0
    slot.init(handle)
    for part in taken:
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: reached // 1000)  # noqa: B023
        if part:
            assert not list(slot.handleInputRows((0,), (pd.DataFrame(part[i : i + 7]) for i in range(0, len(part), 7)), times))
        assert len(handle.timers) <= 1
        for ms in [x for x in handle.timers if x * 1000 <= reached]:
            got += [tuple(r) for df in slot.handleExpiredTimer((0,), times, ms) for r in df.astype(object).itertuples(index=False)]
            handle.timers.remove(ms)
        assert len(handle.timers) <= 1 and all(x * 1000 > reached for x in handle.timers)
        reached = max([reached, *(r["us"] // 1000 * 1000 - delay * 1000 for r in part)])
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_a_waiting_request_is_forgotten(spark, tmp_path):
    """A response that comes after the idle time has no pair; one that came before it has, whatever other ids of the slot do."""
    transform = lambda e: o.stream_llm_pairs(e, "10 minutes", idle_ms=3_600_000, slots=1)
    call = lambda i, r, kind, at: line("s", i, f"llm.{kind}", {"request_id": r, "model": "m"}, at=at)
    parts = [
        [call(1, "a", "request", 1), call(2, "b", "request", 2), call(3, "c", "request", 3), call(4, "c", "response", 3)],
        [call(5, "d", "request", 2000)],
        [call(6, "b", "response", 3000)],
        [call(7, "d", "request", 8000)],
        [call(8, "a", "response", 9000), call(9, "d", "response", 9000)],
        [call(10, "e", "request", 20_000)],
    ]
    out = triggers(spark, tmp_path, parts, transform, "append")
    assert sorted(tuple(x) for x in out.select("request_id", "first_sequence", "second_sequence").collect()) == [("b", 2, 6), ("c", 3, 4), ("d", 7, 9)]


def states(out):
    last = out.groupBy("session_id").agg(F.max_by(F.struct("status", "phase", "progress", "layer", "best_layer", "overall", "valid_pairs", "llm_calls", "last_sequence"), "batch_id").alias("x"))
    return {x["session_id"]: tuple(x["x"]) for x in last.collect()}


def session_lines():
    kinds = [
        ("vector.created", {"layer": 9}), ("session.started", {}), ("vector.created", {"layer": 2}), ("contrast.pair_validated", {"is_valid": True}), ("llm.response", {}), ("evaluation.completed", {"scores": {"overall": 0.4}}),
        ("vector.selected", {"layer": 5, "strength": 1.5}), ("evaluation.started", {}), ("llm.response", {}), ("session.completed", {"success": True, "final_score": 0.9}), ("vector.created", {"layer": 1}),
    ]
    return [line(s, i + 1, kind, body) for i, (kind, body) in enumerate(kinds) for s in "st"]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_of_shuffled_triggers(spark, tmp_path, seed):
    """Four triggers in any order end in the state that one trigger in order gives."""
    lines = session_lines()
    whole = states(triggers(spark, tmp_path / "whole", [lines], o.stream_session_state, "update"))
    assert whole["s"] == ("completed", "optimizing", 1.0, 1, 5, 0.9, 1, 2, 11)
    assert states(triggers(spark, tmp_path / "parts", shuffled(lines, 4, seed), o.stream_session_state, "update")) == whole


def test_late_events_and_forgotten_sessions(spark, tmp_path):
    """Behind the watermark an event counts no more; a session that is idle for long starts anew."""
    transform = lambda e: o.stream_session_state(e, "10 minutes", idle_ms=3_600_000)
    parts = [
        [line("s", 1, "session.started"), line("s", 3, "llm.response", at=30)],
        [line("t", 1, "session.started", at=4000)],  # the watermark passes s
        [line("s", 2, "llm.response", at=20), line("t", 2, "llm.response", at=4001)],  # late for s
        [line("t", 3, "llm.response", at=40_000)],  # the idle time of s is over
        [line("t", 4, "llm.response", at=60_000)],
        [line("s", 4, "llm.response", at=60_000)],
    ]
    out = triggers(spark, tmp_path, parts, transform, "update")
    rows = {(x["session_id"], x["last_sequence"]): (x["status"], x["llm_calls"]) for x in out.collect()}
    assert rows["s", 3] == ("running", 1) and ("s", 2) not in rows
    assert rows["t", 2] == ("running", 1)
    assert rows["s", 4] == ("", 0)  # forgotten: nothing counts before a start


def test_progress_of_shuffled_triggers(spark, tmp_path):
    lines = [line(s, i, "optimization.completed" if i % 3 else "state.update", at=10 * i) for s in ("a", "b") for i in range(1, 20)]
    planned = spark.createDataFrame([("a", 40)], "session_id string, total long")
    out = triggers(spark, tmp_path, shuffled(lines, 3, 5), lambda e: o.stream_progress(e, planned), "update")
    last = {x["session_id"]: x["x"] for x in out.groupBy("session_id").agg(F.max_by(F.struct("done", "total", "elapsed", "rate", "share", "remaining"), "batch_id").alias("x")).collect()}
    assert tuple(last["a"]) == (13, 40, 180.0, 13 / 180, 13 / 40, 27 / (13 / 180))
    assert tuple(last["b"]) == (13, None, 180.0, 13 / 180, 0.0, 0.0)
