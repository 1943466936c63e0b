"""Keyed streams that wait for order: events are held until the watermark has passed them and handed on by sequence.

Triggers may bring the events of a key in any order, as long as none comes later than the watermark's delay; timestamps don't fall while sequences rise.
State lives in RocksDB: a list of held events and one small row for each key, both forgotten a time after the key's last event. Call pairs have so many
keys that many of them share a slot, whose events are held and paired as tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contrail.operators.replay import field, tokens_of
from contrail.streaming.sessions import EMPTY, STATE, apply_event

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WEEK_MS = 7 * 24 * 3600 * 1000


def with_keyed_state(df: DataFrame, processor: StatefulProcessor, output: str, mode: str, *keys: str) -> DataFrame:
    """Event-time state by key. Sets the session's state store to RocksDB, which such state needs, for queries started from then on."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df.groupBy(*keys).transformWithStateInPandas(processor, output, mode, "eventTime")


class Ordered(StatefulProcessor):
    """A key's held events (us, sequence and the columns of HELD) and its state, a row of VALUE. Subclasses fold released events into the state."""

    HELD = ""
    VALUE = ""

    def __init__(self, idle_ms: int = WEEK_MS):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"us long, sequence long, {self.HELD}")
        self.value = handle.getValueState("value", f"last_us long, {self.VALUE}")
        self.columns = ["us", "sequence", *(c.split()[0] for c in self.HELD.split(", "))]

    def fold(self, state: tuple | None, events: list[tuple]) -> tuple[tuple, list[dict]]:
        """The state after the events, which come by sequence, and what they give out."""
        raise NotImplementedError

    def now(self, state: tuple | None, events: list[tuple]) -> list[dict]:
        """What a trigger gives out at once, given the held events by sequence; none unless a subclass says so."""
        return []

    def _state(self) -> tuple[int, tuple | None]:
        have = self.value.get() if self.value.exists() else None
        return (have[0], tuple(have[1:])) if have else (0, None)

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def _frame(self, key: tuple, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            yield self.typed(pd.DataFrame([{**dict(zip(self.keys(), key)), **r} for r in rows]))

    def keys(self) -> list[str]:
        return ["session_id"]

    def typed(self, out: pd.DataFrame) -> pd.DataFrame:
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [t for df in rows for t in df[self.columns].astype(object).where(df[self.columns].notna(), None).itertuples(index=False, name=None)]
        self.held.appendList(new)
        self._wake(min(t[0] for t in new))
        yield from self._frame(key, self.now(self._state()[1], sorted(map(tuple, self.held.get()), key=lambda t: t[1])))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.held.get()), key=lambda t: t[1])
        due, rest = [t for t in rows if t[0] <= reached], [t for t in rows if t[0] > reached]
        last, state = self._state()
        out: list[dict] = []
        if due:
            state, out = self.fold(state, due)
            last = max([last, *(t[0] for t in due)])
            self.value.update((last, *state))
            self.held.put(rest) if rest else self.held.clear()
        if rest:
            self._wake(min(t[0] for t in rest))
        elif last + self.idle * 1000 <= reached:
            self.value.clear()
        else:
            self._wake(last + self.idle * 1000)
        yield from self._frame(key, out)


#: Slots that the ids of calls are dealt to: a slot costs some calls to the state store a trigger, an id none.
SLOTS = 1024
#: Rows of a table in the state.
CHUNK = 1 << 16
#: An event of a call; value: the model of a request, the tokens of a response.
CALL = pa.schema([("session_id", pa.string()), ("request_id", pa.string()), ("us", pa.int64()), ("sequence", pa.int64()), ("response", pa.bool_()), ("value", pa.string())])


def packed(rows: pa.Table) -> list[tuple[bytes]]:
    """The table as rows of a list state."""
    out = []
    for batch in rows.combine_chunks().to_batches(max_chunksize=CHUNK):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(state: Iterator[tuple[bytes]]) -> pa.Table:
    return pa.concat_tables([CALL.empty_table(), *(pa.ipc.open_stream(x[0]).read_all() for x in state)])


def _codes(rows: pa.Table) -> list[np.ndarray]:
    """Numbers that are equal where session and id are."""
    return [pc.dictionary_encode(rows[c].combine_chunks()).indices.to_numpy(zero_copy_only=False) for c in ("session_id", "request_id")]


def paired(asked: pa.Table, due: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """(requests, their responses, requests that wait on), given the requests that have waited, at most one of an id, and the events after them in any order."""
    rows = pa.concat_tables([asked, due])
    session, request = _codes(rows)
    order = np.lexsort((rows["sequence"].to_numpy(), np.arange(len(rows)) >= len(asked), request, session))
    same = (session[order][1:] == session[order][:-1]) & (request[order][1:] == request[order][:-1])
    response = rows["response"].to_numpy()[order]
    first = np.flatnonzero(same & ~response[:-1] & response[1:])
    last = np.flatnonzero(~np.append(same, False) & ~response)
    return rows.take(order[first]), rows.take(order[first + 1]), rows.take(order[last])


class CallPairs(StatefulProcessor):
    """Each response with the request that is the last event of its id before it. The key is a slot: its state is the events held, the requests that wait for
    a response and the time it wakes next."""

    OUTPUT = "session_id string, request_id string, first_sequence long, second_sequence long, seconds double, model string, tokens long"

    def __init__(self, idle_ms: int = WEEK_MS):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.asked = handle.getListState("asked", "rows binary")
        self.wakes = handle.getValueState("wakes", "ms long")

    def _keep(self, state, rows: pa.Table) -> None:
        """The rows in place of the state's; a message each for large tables."""
        state.clear()
        for row in packed(rows):
            state.appendValue(row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for df in rows:
            self.held.appendList(packed(pa.Table.from_pandas(df[CALL.names], CALL, preserve_index=False).replace_schema_metadata()))
            first = min(x for x in (first, int(df["us"].min())) if x is not None)
        due, old = -(-first // 1000), self.wakes.get()
        if old is None or due < old[0]:
            if old is not None:
                self.handle.deleteTimer(old[0])
            self.handle.registerTimer(due)
            self.wakes.update((due,))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        held, before = unpacked(self.held.get()), unpacked(self.asked.get())
        passed = pc.less_equal(held["us"], reached)
        rest = held.filter(pc.invert(passed))
        first, second, asked = paired(before, held.filter(passed))
        # who has waited for too long is forgotten, unless more of the id has come
        idle = pc.less_equal(pc.add(asked["us"], self.idle * 1000), reached).to_numpy()
        if idle.any():
            more = set(zip(rest["session_id"].to_pylist(), rest["request_id"].to_pylist(), strict=True))
            ids = zip(asked["session_id"].to_pylist(), asked["request_id"].to_pylist(), strict=True)
            stays = np.array([not gone or x in more for x, gone in zip(ids, idle, strict=True)], bool)
            asked, idle = asked.filter(pa.array(stays)), idle[stays]
        if len(rest) < len(held):
            self._keep(self.held, rest)
        if not asked.equals(before):
            self._keep(self.asked, asked)
        ahead = np.concatenate([rest["us"].to_numpy(), asked["us"].to_numpy()[~idle] + self.idle * 1000])
        if len(ahead):
            wakes = -(-int(ahead.min()) // 1000)
            self.handle.registerTimer(wakes)
            self.wakes.update((wakes,))
        else:
            self.wakes.clear()
        if len(first):
            yield self._frame(first, second)

    def _frame(self, first: pa.Table, second: pa.Table) -> pd.DataFrame:
        columns = {
            "session_id": first["session_id"], "request_id": first["request_id"], "first_sequence": first["sequence"], "second_sequence": second["sequence"],
            "seconds": pc.divide(pc.cast(pc.subtract(second["us"], first["us"]), pa.float64()), 1e6), "model": first["value"], "tokens": pc.cast(second["value"], pa.int64()),
        }
        return pd.DataFrame({name: x.to_pandas(integer_object_nulls=True) for name, x in columns.items()})


class SessionState(Ordered):
    """The live fold. A trigger gives out the state over everything that has come, in order: what is held is folded on top of what is final, and folded
    again when an event comes that belongs before it."""

    HELD = "event_type string, payload string"
    VALUE = STATE.split(", ", 1)[1]
    FIELDS = [f.split()[0] for f in STATE.split(", ")][1:]

    def _fold(self, state, events) -> dict:
        state = dict(zip(self.FIELDS, state, strict=True)) if state else dict(EMPTY)
        for _, sequence, kind, payload in events:
            if sequence > state["last_sequence"]:
                state = apply_event(state, kind, json.loads(payload or "{}")) | {"last_sequence": int(sequence)}
        return state

    def fold(self, state, events):
        return tuple(self._fold(state, events)[f] for f in self.FIELDS), []

    def now(self, state, events):
        return [self._fold(state, events)]

    def typed(self, out: pd.DataFrame) -> pd.DataFrame:
        return out.astype({"layer": "Int32", "best_layer": "Int32"})


class Progress(StatefulProcessor):
    """Counts and times of a session; order doesn't matter, so nothing is held."""

    OUTPUT = "session_id string, done long, total long, elapsed double, rate double, share double, remaining double"

    def __init__(self, idle_ms: int = WEEK_MS):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "done long, first_us long, last_us long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, first, last, total = self.value.get() if self.value.exists() else (0, None, None, None)
        for df in rows:
            done += int(df["done"].sum())
            first = min(x for x in (first, int(df["us"].min())) if x is not None)
            last = max(x for x in (last, int(df["us"].max())) if x is not None)
            known = df["total"].dropna()
            total = int(known.iloc[0]) if len(known) else total
        self.value.update((done, first, last, total))
        self.handle.registerTimer(last // 1000 + self.idle)
        elapsed, of = (last - first) / 1e6, total or 0
        rate = done / elapsed if elapsed > 0 else 0.0
        row = {"session_id": key[0], "done": done, "total": total, "elapsed": elapsed, "rate": rate, "share": done / of if of > 0 else 0.0, "remaining": (of - done) / rate if rate > 0 and total is not None else 0.0}
        yield pd.DataFrame([row]).astype({"total": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists() and self.value.get()[2] // 1000 + self.idle <= timerValues.getCurrentWatermarkInMs():
            self.value.clear()
        yield from ()


def stream_llm_pairs(events: DataFrame, delay: str = "1 hour", idle_ms: int = WEEK_MS, slots: int = SLOTS) -> DataFrame:
    """session_id, request_id, first_sequence, second_sequence, seconds, model, tokens: exactly the pairs of pair_llm_calls, each once (append mode), when the
    watermark has passed the response. Calls without a session or id have no pair. A request that waits longer than `idle_ms` for its response is forgotten.

    The ids are dealt to `slots` keys. A trigger writes a slot's state as a whole if the watermark passes one of its events, so state is what came within the delay and
    the requests that wait; one task holds a slot's in memory. Slots of a running query can't change."""
    own = events.withWatermark("timestamp", delay).where("event_type in ('llm.request', 'llm.response') and session_id is not null").withColumn("request_id", field("request_id"))
    own = own.where("request_id is not null").withColumn("response", F.col("event_type") == "llm.response")
    value = F.when(F.col("response"), tokens_of().cast("string")).otherwise(field("model"))
    slot = F.pmod(F.xxhash64("session_id", "request_id"), F.lit(slots)).alias("slot")
    own = own.select(slot, "session_id", "request_id", "timestamp", F.unix_micros("timestamp").alias("us"), "sequence", "response", value.alias("value"))
    return with_keyed_state(own, CallPairs(idle_ms), CallPairs.OUTPUT, "append", "slot")


def stream_session_state(events: DataFrame, delay: str = "1 hour", idle_ms: int = WEEK_MS) -> DataFrame:
    """One row per session and trigger with its state so far (update mode), over all events that came, by sequence: an event that comes in a later trigger than
    its successors counts where it belongs, unless it is later than the watermark's delay. A session is forgotten `idle_ms` after its last event."""
    own = events.withWatermark("timestamp", delay).where("session_id is not null")
    own = own.select("session_id", "timestamp", F.unix_micros("timestamp").alias("us"), "sequence", "event_type", "payload")
    return with_keyed_state(own, SessionState(idle_ms), STATE, "update", "session_id")


def stream_progress(events: DataFrame, planned: DataFrame | None = None, kind: str = "optimization.completed", delay: str = "1 hour", idle_ms: int = WEEK_MS) -> DataFrame:
    """session_id, done, total, elapsed, rate a second, share and remaining seconds so far (update mode), as progress has them; total from planned(session_id,
    total), a table; without one share and remaining are 0. State is four numbers a session, forgotten `idle_ms` after its last event."""
    own = events.withWatermark("timestamp", delay).where("session_id is not null")
    own = own.select("session_id", "timestamp", F.unix_micros("timestamp").alias("us"), (F.col("event_type") == kind).alias("done"))
    if planned is None:
        own = own.withColumn("total", F.lit(None).cast("long"))
    else:
        own = own.join(planned.select("session_id", F.col("total").cast("long").alias("total")), "session_id", "left")
    return with_keyed_state(own, Progress(idle_ms), Progress.OUTPUT, "update", "session_id")
