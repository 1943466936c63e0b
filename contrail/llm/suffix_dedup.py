"""Removes bytes of 200-byte strings that occur again: per-shard suffix arrays in numpy, merged by binary search.

A task's packed strings (see repeats.py) come sorted by anchor and fill shards of bounded size. Each shard gets a suffix
array by Larsson-Sadakane refinement (ranks of 7 bytes, doubled; groups of one are never sorted again) and common prefixes
of neighbours in Kasai's text order: a position of one string whose left place has the neighbour's left place as its own
neighbour inherits the prefix less one, only the others are compared. Windows still alone look for themselves in the other shards of their anchor by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contrail.llm.common import column
from contrail.llm.repeats import PACKED, Unit, mark_rows, remove_repeats

UNIT = Unit(words=False, length=200, gram=64)
#: Bytes of packed strings in one suffix array.
SHARD = 2 << 20
#: Symbols (9 bits each) that one key holds, and the longest packed string's length.
PACK, LONGEST = 7, 2 * UNIT.length


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The next 7 symbols of each position as one number; beyond the end: 0."""
    out = np.zeros(len(codes), np.int64)
    for j in range(PACK):
        out <<= 9
        out[: len(codes) - j] |= codes[j:]
    return out


def suffix_array(codes: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """Suffixes in order of at least their first `depth` symbols."""
    n = len(codes)
    keys = keys_of(codes)
    order = np.argsort(keys, kind="stable")
    head = np.ones(n, bool)
    head[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = PACK
    while h < depth:
        todo = np.flatnonzero(~(head & np.append(head[1:], True)))  # members of groups of two or more
        if not len(todo):
            break
        at = order[todo]
        after = at + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        at, both = at[by], both[by]
        order[todo] = at
        head[todo[1:]] |= both[1:] != both[:-1]
        rank[at] = np.maximum.accumulate(np.where(head[todo], todo, 0))
        h *= 2
    return order


def common_prefixes(codes: np.ndarray, order: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """For each place in the order, symbols shared with the place before; up to `most` less the place's distance from its string's start
    they are told right. A string's first place (left code 0) compares for itself, and ties that the order's depth leaves do so too."""
    n = len(codes)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    inherits = np.zeros(n, bool)
    inherits[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (codes[:-1] == codes[np.maximum(before[1:] - 1, 0)]) & (codes[:-1] != 0)
    own = np.flatnonzero(~inherits)
    shared = np.zeros(n, np.int64)
    keys = keys_of(codes)
    act = own[before[own] >= 0]
    length = np.zeros(len(act), np.int64)
    for unit, values in ((PACK, keys), (1, codes)):
        live = np.arange(len(act))
        while len(live):
            x, y = act[live] + length[live], before[act[live]] + length[live]
            ok = (x < n) & (y < n) & (length[live] < most)
            ok[ok] = values[x[ok]] == values[y[ok]]
            live = live[ok]
            length[live] += unit
    shared[act] = length
    source = np.maximum.accumulate(np.where(inherits, 0, np.arange(n)))
    text_order = np.maximum(shared[source] - (np.arange(n) - source), 0)
    return text_order[order]


class Shard:
    """Packed strings (PACKED rows) of one shard: codes (0 ends a string), window starts and which of them repeat. A string that
    occurs more than once stands there twice, so that the array finds its windows as any others."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        strings = [r[6] for r in rows] + [r[6] for r in rows if r[5] > 1]
        sizes = np.array([len(x) for x in strings], np.int64)
        self.n = np.array([r[4] for r in rows], np.int64)
        ends = np.cumsum(sizes + 1)
        self.codes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        self.codes[ends - 1] = 0
        firsts = ends - sizes - 1
        self.row = np.repeat(np.arange(len(rows)), self.n)
        self.start = firsts[self.row] + np.arange(len(self.row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.order = suffix_array(self.codes)
        place = np.flatnonzero(common_prefixes(self.codes, self.order) >= UNIT.length)
        self.again = np.zeros(len(self.codes), bool)
        self.again[self.order[place]] = True
        self.again[self.order[place - 1]] = True
        self.keys = None

    def windows(self, anchor: int) -> np.ndarray:
        """Starts of the anchor's windows not yet known to repeat."""
        mine = np.array([r[0] == anchor for r in self.rows])
        at = self.start[mine[self.row]]
        return at[~self.again[at]]

    def look_up(self, other: Shard, at: np.ndarray) -> np.ndarray:
        """For windows of another shard: the place here that equals each, or -1; binary search over this suffix order."""
        for s in (self, other):
            if s.keys is None:
                s.keys = keys_of(s.codes)
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        n, m = len(self.codes), len(other.codes)

        def compare(places: np.ndarray, queries: np.ndarray) -> np.ndarray:
            """-1, 0, 1: the suffix here against the first 200 symbols of the query."""
            out = np.zeros(len(places), np.int64)
            live = np.arange(len(places))
            for d in range(0, UNIT.length, PACK):
                step = d if d + PACK <= UNIT.length else UNIT.length - PACK  # the last key overlaps
                x, y = places[live] + step, queries[live] + step
                a, b = np.where(x < n, self.keys[np.minimum(x, n - 1)], 0), np.where(y < m, other.keys[np.minimum(y, m - 1)], 0)
                out[live] = np.sign(a - b)
                live = live[a == b]
                if not len(live):
                    break
            return out

        found = np.full(len(at), -1, np.int64)
        live = np.arange(len(at))
        while len(live):
            middle = (low[live] + high[live]) >> 1
            c = compare(self.order[middle], at[live])
            found[live[c == 0]] = self.order[middle[c == 0]]
            low[live] = np.where(c < 0, middle + 1, low[live])
            high[live] = np.where(c > 0, middle, high[live])
            live = live[(c != 0) & (low[live] < high[live])]
        return found

    def marks(self) -> pa.RecordBatch:
        flags = np.split(self.again[self.start], np.cumsum(self.n)[:-1])
        return mark_rows(self.rows, [np.packbits(x).tobytes() for x in flags], lambda string, n: [string[i : i + UNIT.length] for i in range(n)])


def merge(shards: list[Shard], new: Shard, anchor: int) -> None:
    """Mark the anchor's windows that occur in the new shard and in an earlier one."""
    for old in shards:
        for here, there in ((old, new), (new, old)):
            at = there.windows(anchor)
            found = here.look_up(there, at) if len(at) else at
            there.again[at[found >= 0]] = True
            here.again[found[found >= 0]] = True


def count_bytes(batches: Iterator[pa.RecordBatch], shard: int | None = None) -> Iterator[pa.RecordBatch]:
    """Shards are cut wherever they are full; those that an anchor spans are held until the anchor ends."""
    limit = shard or SHARD
    held: list[Shard] = []
    rows: list[tuple] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        new = Shard(rows)
        if held and held[-1].rows[-1][0] == rows[0][0]:
            merge(held, new, rows[0][0])
        if held and rows[0][0] != rows[-1][0] or held and held[-1].rows[-1][0] != rows[0][0]:
            yield from (s.marks() for s in held)
            held.clear()
        held.append(new)

    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in PACKED), strict=True):
            if size >= limit:
                yield from close()
                rows, size = [], 0
            rows.append(row)
            size += (len(row[6]) + 1) * min(row[5], 2)
    if rows:
        yield from close()
    yield from (s.marks() for s in held)


def suffix_dedup(docs: DataFrame, part: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs(doc_id, text).

    Texts are UTF-8 bytes. Each byte goes that is covered by a 200-byte string which also starts anywhere else, in the same
    document or another; overlaps count, strings are judged on the input, and none crosses documents. n_spans: maximal removed
    runs; the digest is of the bytes that stay. Null and empty texts have no bytes, texts under 200 bytes lose none.
    Repeated rows are documents of their own: their texts repeat as a whole. Rows that share a doc_id and differ in text are judged
    apart. A text of any length is one document, handed out in bounded pieces. Null doc_ids stay; other columns are ignored,
    whatever their names; an empty table gives no rows. part: different strings of one anchor that one task counts.
    """
    out = remove_repeats(docs, UNIT, count_bytes, **({"part": part} if part is not None else {}))
    return out.select("doc_id", out.n_units.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op7(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every 200-byte string of every text by its digest (as hexadecimal digits, cut in blocks first), runs of those that recur, and what lies between.
OP7_SQL = r"""
with bytes as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
blocks as (select r, b, least(512, length(h) // 2 - 199 - b) as n, h[2 * b + 1:2 * b + 1422] as h from (select r, h, unnest(range(0, length(h) // 2 - 199, 512)) as b from bytes)),
starts as (select r, b + i as s, md5(h[2 * i + 1:2 * i + 400]) as w from (select r, b, h, unnest(range(n)) as i from blocks)),
twice as (select w from starts group by w having count(*) > 1),
hits as (select r, s, lag(s) over (partition by r order by s) as before from starts join twice using (w)),
runs as (select r, s, sum(case when before is null or s > before + 200 then 1 else 0 end) over (partition by r order by s) as run from hits),
spans as (select r, run, min(s) as a, max(s) + 200 as b from runs group by r, run),
gaps as (
  select r, coalesce(lag(b) over (partition by r order by a), 0) as a, a as b from spans union all select r, max(b), null from spans group by r),
kept as (select r, string_agg(h[2 * a + 1:coalesce(2 * b, length(h))], '' order by a) as k from gaps join bytes using (r) group by r),
removed as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by r)
select doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from bytes left join removed using (r) left join kept using (r)
"""
