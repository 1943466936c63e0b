"""Windows of L units (bytes or words) that occur more than once in a corpus: the part that byte and word dedup share.

1. Super-k-mers. The anchor of a window is the smallest hash among its k-grams (leftmost on ties); consecutive windows with
   one anchor form a run. Equal windows have equal anchors, so a run whose anchor no other run has holds no repeat: only
   such runs are left out.
2. Rows with equal texts are one text with a count. A text that several rows have repeats as a whole; it hands its strings
   out once, as two occurrences, for what other texts have in common with it.
3. All other runs travel as packed strings to their anchor's bucket. Equal strings collapse to one with its occurrences,
   and an exact counter (suffix arrays for bytes, sorting for words) marks the windows that repeat.
4. A bucket of over `part` different strings is dealt to several tasks. Each counts its own strings; then the windows'
   128-bit fingerprints tell which windows two of these tasks have in common.
5. The marks go back to the documents, which drop the covered units.

No step drops or caps a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import Rolling, Words, byte_units, column, mix, packed, slices, stage, window_minima

#: Windows anchored at once; a longer text is anchored in parts, its runs are cut there.
STEP = 1 << 22
#: Different packed strings of one anchor that meet in one task; bytes of packed strings in one Arrow batch.
PART, BATCH = 8192, 8 << 20
RUN = "k1 long, k2 long, start int, n int, anchor long, run long"


@dataclass(frozen=True)
class Unit:
    """words or bytes, the window's length and the anchor's."""

    words: bool
    length: int
    gram: int

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Unit codes and each text's first unit, with the end as last."""
        data, off = packed(texts)
        if not self.words:
            return byte_units(data), off
        words = Words(data, off)
        return words.hash, words.first


class Units:
    """The units of several texts in one buffer of bytes; words are followed by one blank each."""

    def __init__(self, unit: Unit, texts: pa.Array):
        data, off = packed(texts)
        if unit.words:
            words = Words(data, off)
            self.first, size = words.first, words.end - words.start
            self.begin = np.cumsum(size + 1) - size - 1
            self.end = self.begin + size
            number = np.repeat(np.arange(len(size)), size)
            self.buffer = np.full(len(number) + len(size), 32, np.uint8)
            at = np.arange(len(number))
            self.buffer[at + number] = data[at + np.repeat(words.start - np.cumsum(size) + size, size)]
            self.blank = 1
        else:
            self.first, self.buffer, self.blank = off, data, 0
            self.begin = np.arange(len(data))
            self.end = self.begin + 1

    def strings(self, a: np.ndarray, b: np.ndarray) -> pa.Array:
        """The bytes of units a to b (exclusive) of each pair."""
        start, size = self.begin[a], self.end[b - 1] - self.begin[a]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(start - ends + size, size)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(self.buffer[at])])

    def results(self, gone: np.ndarray) -> list[pa.Array]:
        """Units, removed units, removed spans and the SHA-256 of what stays, for each text."""
        first = self.first
        n = np.diff(first)
        total = np.concatenate([[0], np.cumsum(gone)])
        heads = gone.copy()
        heads[1:] &= ~gone[:-1]
        starts = first[:-1][n > 0]
        heads[starts] = gone[starts]
        spans = np.concatenate([[0], np.cumsum(heads)])
        kept = self.buffer[np.repeat(~gone, self.end - self.begin + self.blank)] if gone.any() else self.buffer
        ends = np.concatenate([[0], np.cumsum(np.where(gone, 0, self.end - self.begin + self.blank))])[first]
        view = memoryview(np.ascontiguousarray(kept))
        digests = [hashlib.sha256(view[a : max(b - self.blank, a)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [pa.array(n), pa.array(total[first[1:]] - total[first[:-1]]), pa.array(spans[first[1:]] - spans[first[:-1]]), pa.array(digests, pa.string())]


def runs_of(units: np.ndarray, first: np.ndarray, unit: Unit):
    """Runs (document, start in the document, windows, anchor hash) of one slice's texts."""
    size, k = unit.length, unit.gram
    roll = Rolling(units)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    windows = len(units) - size + 1
    out = []
    for lo in range(0, max(windows, 0), STEP):
        hi = min(lo + STEP, windows)
        start = np.arange(lo, hi + size - k)  # grams within these windows
        grams = roll.ranges(start, start + k)
        bits = np.uint64((1 << 24) - 1)
        where = window_minima((grams & ~bits) | np.arange(len(grams), dtype=np.uint64), size - k + 1) & bits
        valid = np.flatnonzero(doc[lo:hi] == doc[lo + size - 1 : hi + size - 1])
        if not len(valid):
            continue
        at = where[valid].astype(np.int64)
        new = np.ones(len(valid), bool)
        new[1:] = (np.diff(valid) != 1) | (np.diff(at) != 0)
        heads = np.flatnonzero(new)
        n = np.diff(np.append(heads, len(valid)))
        start = valid[heads] + lo
        out.append((doc[start], start - first[doc[start]], n, grams[at[heads]]))
    if not out:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            d, start, n, anchor = runs_of(*unit.split(column(batch, "text")), unit)
            k1, k2 = (column(batch, x).to_numpy()[d] for x in ("k1", "k2"))
            number = mix(mix(k1.view(np.uint64)) ^ k2.view(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(k1), pa.array(k2), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(number.view(np.int64))],
                ["k1", "k2", "start", "n", "anchor", "run"],
            )

    return run


#: Rows of documents (start is null) and of packed strings (the others).
FIRST = "doc_id long, k1 long, k2 long, n_units long, n_removed long, n_spans long, kept_sha256 string, text string, start int, n int, anchor long, times int, string binary"
_FIRST = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "k1", "k2", "n_units", "n_removed", "n_spans")] + [("kept_sha256", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("times", pa.int32()), ("string", pa.binary())]
)


def _rows(count: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in _FIRST], schema=_FIRST)


def _first(unit: Unit):
    """Texts without live runs and texts of several rows get their result, the others keep their text and wait; every text with
    live runs hands out its packed strings, once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for batch in slices(batches, "text"):
            texts, live = column(batch, "text"), column(batch, "live")
            units = Units(unit, texts)
            rows = np.bincount(live.value_parent_indices().to_numpy(), minlength=batch.num_rows) > 0 if len(live.flatten()) else np.zeros(batch.num_rows, bool)
            many = column(batch, "times").fill_null(1).to_numpy() > 1
            n = np.diff(units.first)
            results = units.results(np.repeat(many & (n >= unit.length), n))
            waits = rows & ~many
            waiting, ready = (pa.array(np.arange(batch.num_rows), mask=~x) for x in (waits, ~waits))  # null where x is false
            done = [x.take(ready) for x in results[1:]]
            yield _rows(
                batch.num_rows, doc_id=column(batch, "doc_id"), k1=column(batch, "k1"), k2=column(batch, "k2"), n_units=results[0], n_removed=done[0], n_spans=done[1], kept_sha256=done[2],
                text=texts.take(waiting),
            )
            keys = [column(batch, c).to_numpy() for c in ("k1", "k2")]
            for r in np.flatnonzero(rows & many).tolist():
                key = (int(keys[0][r]), int(keys[1][r]))
                rows[r] = key not in told
                told.add(key)
            parent = live.value_parent_indices().to_numpy()
            flat = live.flatten()
            use = np.flatnonzero(rows[parent])
            parent, (start, windows, anchor) = parent[use], (flat.field(i).to_numpy()[use] for i in range(3))
            a = units.first[parent] + start
            b = a + windows - 1 + unit.length
            total = np.cumsum(units.end[b - 1] - units.begin[a]) if len(a) else a
            cuts = [0, *np.searchsorted(total, np.arange(BATCH, total[-1], BATCH)).tolist(), len(a)] if len(a) else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo < hi:
                    p = parent[lo:hi]
                    yield _rows(
                        hi - lo, k1=pa.array(keys[0][p]), k2=pa.array(keys[1][p]), start=pa.array(start[lo:hi]), n=pa.array(windows[lo:hi]), anchor=pa.array(anchor[lo:hi]),
                        times=pa.array(many[p].astype(np.int32) + 1), string=units.strings(a[lo:hi], b[lo:hi]),
                    )

    return run


RESULT = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"


def _last(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            units = Units(unit, column(batch, "text"))
            marks = column(batch, "marks")
            step = np.zeros(len(units.begin) + 1, np.int64)
            if len(marks.flatten()):
                parent, flat = marks.value_parent_indices().to_numpy(), marks.flatten()
                bits, size = packed(flat.field(1))
                flags = np.unpackbits(bits)  # 8 a byte; each mask starts at its own byte
                at = np.flatnonzero(flags)
                which = np.searchsorted(size, at >> 3, "right") - 1
                windows = np.unique((units.first[parent] + flat.field(0).to_numpy())[which] + at - size[which] * 8)
                np.add.at(step, windows, 1)
                np.add.at(step, windows + unit.length, -1)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *units.results(np.cumsum(step[:-1]) > 0)], ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    return run


#: What a counter gets, for whole (anchor, part) groups in order, and what it yields: a bit mask of the windows that occur again
#: and, of an anchor in several parts, the windows' 16-byte fingerprints one after the other.
PACKED = ["anchor", "part", "parts", "content", "n", "times", "string"]
MARK = "anchor long, part int, content long, mask binary, prints binary"


def mark_rows(rows: list[tuple], masks: list[bytes], window: Callable[[bytes, int], list[bytes]]) -> pa.RecordBatch:
    """MARK rows for PACKED rows and their masks; window(string, n) lists the n windows of a string."""
    prints = [b"".join(xxhash.xxh3_128_digest(w) for w in window(r[6], r[4])) if r[2] > 1 else None for r in rows]
    columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64()), pa.array(masks, pa.binary()), pa.array(prints, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "part", "content", "mask", "prints"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per fingerprint, with whether its window is marked already."""
    for batch in slices(batches, "prints", 1 << 20):
        bits, off = packed(column(batch, "prints"))
        pair = bits.view(np.int64).reshape(-1, 2)
        n = np.diff(off) // 16
        row = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        masks, begin = packed(column(batch, "mask"))
        known = np.unpackbits(masks)[begin[row] * 8 + i].astype(bool)
        columns = [column(batch, c).take(pa.array(row)) for c in ("anchor", "part", "content")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(i), pa.array(known), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["anchor", "part", "content", "i", "known", "w1", "w2"])


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for hits in column(batch, "hits").to_pylist():
            flags = np.zeros(max(hits) + 1, bool)
            flags[hits] = True
            masks.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([column(batch, "anchor"), column(batch, "content"), pa.array(masks, pa.binary())], ["anchor", "content", "mask"])


def remove_repeats(docs: DataFrame, unit: Unit, counter: Callable, part: int = PART) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text); see the two callers.

    counter: mapInArrow function from PACKED to MARK.
    """
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), F.coalesce(text, F.lit(""))).alias("k2"))
    runs = docs.select("k1", "k2", "text").mapInArrow(_scan(unit), RUN)
    # tables of their own, so that the joins' two sides are plain shuffles and a hot key's rows can be split over tasks
    anchors = stage(runs.groupBy("anchor").agg(F.min("run").alias("x"), F.max("run").alias("y")).where("x <> y").select("anchor"))
    live = runs.join(anchors, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n", "anchor")).alias("live"))
    copies = docs.groupBy("k1", "k2").agg(F.count("*").alias("times")).where("times > 1")
    known = stage(live.join(copies, ["k1", "k2"], "full"))
    first = stage(docs.join(known, ["k1", "k2"], "left").mapInArrow(_first(unit), FIRST))
    strings = first.where("start is not null").select("k1", "k2", "start", "n", "anchor", "times", "string", F.xxhash64("string").alias("content"))
    apart = stage(strings.groupBy("anchor", "content").agg(F.sum("times").alias("times"), F.first("n").alias("n"), F.first("string").alias("string")))
    crowded = stage(apart.groupBy("anchor").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1"))
    dealt = apart.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("content", "parts").cast("int"))
    dealt = dealt.select(*PACKED).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "content")
    marks = stage(dealt.mapInArrow(counter, MARK))
    windows = marks.where("prints is not null").mapInArrow(_windows, "anchor long, part int, content long, i long, known boolean, w1 long, w2 long")
    again = windows.groupBy("w1", "w2").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("w1", "w2")
    across = windows.where("not known").join(again, ["w1", "w2"]).groupBy("anchor", "content").agg(F.collect_list("i").alias("hits")).mapInArrow(_masks, "anchor long, content long, mask binary")
    marks = marks.select("anchor", "content", "mask").unionByName(across)
    found = strings.select("k1", "k2", "start", "anchor", "content").join(marks, ["anchor", "content"])
    found = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    late = first.where("text is not null and start is null").select("doc_id", "k1", "k2", "text").join(found, ["k1", "k2"], "left").mapInArrow(_last(unit), RESULT)
    return first.where("kept_sha256 is not null").select("doc_id", "n_units", "n_removed", "n_spans", "kept_sha256").unionByName(late)
