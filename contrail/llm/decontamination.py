"""Benchmark decontamination by SimHash over item-sized windows.

Per benchmark item, documents are read in windows of as many words as the item has (a shorter document is one window). A
window can be similar to an item only if at least S / (1 + S) of both's shingles, S = 0.8, are shingles of such items; others are never
hashed, which loses nothing. The 64-bit SimHash of a window (every shingle occurrence votes on each bit) is looked up in a multi-index: a
table from (block, value) to items, 8 blocks of 8 bits, each item posted under all values up to 2 bits from its own, so that every
item within 23 bits is met in at least one block (23 // 8 = 2). A pair of similarity 0.8 lies about 10 bits apart, over 23
with probability 2e-6. Candidates are verified by weighted Jaccard: sums of minima and maxima of shingle counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.common import Rolling, Words, column, mix, packed, slices, stage

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Items and bytes of one index that is sent to all executors; a larger benchmark is matched in several passes.
ITEMS, BYTES = 4096, 16 << 20

#: Words whose votes are summed at once, windows that are looked up at once.
SEGMENT, LOOKUPS = 1 << 16, 512

_near = [np.array([v for v in range(256) if (v ^ own).bit_count() <= RADIUS // BLOCKS]) for own in range(256)]


def simhash(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each run of n shingles (starts ascending); ties of votes give 0."""
    out = np.zeros(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        upto = int(np.searchsorted(starts, low + SEGMENT, "right"))
        part = shingles[low : int(starts[upto - 1]) + n]
        at = starts[done:upto] - low
        sums = np.zeros(len(part) + 1, np.int64)
        for bit in range(64):
            np.cumsum((part >> np.uint64(bit)) & np.uint64(1), out=sums[1:])
            out[done:upto] |= (2 * (sums[at + n] - sums[at]) > n).astype(np.uint64) << np.uint64(bit)
        done = upto
    return out


def least_common(n: int, m: int) -> int:
    """Shingles that sets of n and m must have in common for the similarity."""
    return max(1, math.ceil(SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9))


class Size:
    """Items of as many words, all of their shingles, and the table that is probed."""

    def __init__(self, words: int, items: list[int], shingles: list[tuple[np.ndarray, np.ndarray]], prints: list[int]):
        self.words, self.k = words, min(SHINGLE, words)
        self.m = words - self.k + 1
        self.items, self.prints = np.array(items), np.array(prints, np.uint64)
        self.keys = np.unique(np.concatenate([s for s, _ in shingles]))
        keys, posts = [], []
        for i, fingerprint in enumerate(prints):
            for b in range(BLOCKS):
                values = _near[fingerprint >> 8 * b & 255]
                keys.append(values + 256 * b)
                posts.append(np.full(len(values), i))
        keys = np.concatenate(keys)
        by = np.argsort(keys, kind="stable")
        self.posts = np.concatenate(posts)[by].astype(np.int32)
        self.first = np.searchsorted(keys[by], np.arange(256 * BLOCKS + 1))

    def probe(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place of the item, distance) of all items within the radius of each fingerprint."""
        blocks = ((fingerprints[:, None] >> np.arange(0, 64, 8, dtype=np.uint64)) & np.uint64(255)).astype(np.int64) + 256 * np.arange(BLOCKS)
        start, n = self.first[blocks].ravel(), (self.first[blocks + 1] - self.first[blocks]).ravel()
        ends = np.cumsum(n)
        met = self.posts[np.arange(ends[-1]) + np.repeat(start - ends + n, n)]
        pairs = np.unique(np.repeat(np.arange(len(n)) // BLOCKS, n) * len(self.items) + met)
        window, item = pairs // len(self.items), pairs % len(self.items)
        distance = np.bitwise_count(fingerprints[window] ^ self.prints[item])
        near = distance <= RADIUS
        return window[near], item[near], distance[near]


class Index:
    """The items of one pass by their number of words."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words(*packed(pa.array([t for _, t in items], pa.string())), lower=True)
        roll = Rolling(words.hash)
        self.ids: list[int] = []
        self.counts: list[tuple[np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[tuple[int, int]]] = {}
        for (item_id, _), a, b in zip(items, words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if a == b:
                continue
            k = min(SHINGLE, b - a)
            at = np.arange(a, b - k + 1)
            shingles = roll.ranges(at, at + k)
            by_size.setdefault(b - a, []).append((len(self.ids), int(simhash(shingles, np.array([0]), len(shingles))[0])))
            self.ids.append(item_id)
            self.counts.append(np.unique(shingles, return_counts=True))
        self.sizes = [Size(n, [i for i, _ in group], [self.counts[i] for i, _ in group], [p for _, p in group]) for n, group in sorted(by_size.items())]
        self.keys = {k: np.unique(np.concatenate([s.keys for s in self.sizes if s.k == k])) for k in {s.k for s in self.sizes}}


def _among(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def windows_of(size: Size, hits: np.ndarray, row_of: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(ascending starts, shingles) of the windows that hold enough of the hits, the places of shingles of items of this size."""
    length = np.diff(first)
    row = row_of[hits]
    need = least_common(size.m, size.m)
    i = np.arange(max(len(hits) - need + 1, 0))
    j = i + need - 1
    i = i[(row[i] == row[j]) & (hits[j] - hits[i] < size.m) & (length[row[i]] >= size.words)]
    if len(i):
        low = np.maximum(first[row[i]], hits[i + need - 1] - size.m + 1)
        high = np.minimum(hits[i], first[row[i] + 1] - size.words)
        low, high = low[low <= high], high[low <= high]
        if len(low):
            step = np.zeros(int(high.max() - low.min()) + 2, np.int64)
            np.add.at(step, low - low.min(), 1)
            np.add.at(step, high + 1 - low.min(), -1)
            yield np.flatnonzero(np.cumsum(step) > 0) + low.min(), size.m
    rows, count = np.unique(row, return_counts=True)
    for r, c in zip(rows.tolist(), count.tolist()):  # texts shorter than the items
        n = int(length[r]) - size.k + 1
        if length[r] < size.words and c >= least_common(n, size.m):
            yield first[r : r + 1], n


def find(index: Index, texts: pa.Array, first_only: bool = False) -> list[tuple[int, int, int, int, int, float]]:
    """(row, item number, first word, words, distance, similarity) of the best window for each text and item it holds; first_only: of one
    window of each text that holds any, and its other windows aren't looked at."""
    words = Words(*packed(texts), lower=True)
    roll = Rolling(words.hash)
    row_of = np.repeat(np.arange(len(texts)), np.diff(words.first))
    best: dict[tuple[int, int], tuple] = {}
    done = np.zeros(len(texts), bool)
    for k, keys in index.keys.items():
        grams = roll.grams(k)
        some = np.flatnonzero(_among(keys, grams) & (row_of[: len(grams)] == row_of[k - 1 :])) if len(grams) else np.empty(0, np.int64)
        if not len(some):
            continue
        for size in index.sizes:
            if size.k != k:
                continue
            hits = some[_among(size.keys, grams[some])]
            for starts, n in windows_of(size, hits, row_of, words.first):
                # of equal windows of one text the first stands for all
                content = roll.ranges(starts, starts + n + k - 1) ^ mix(row_of[starts].astype(np.uint64))
                starts = starts[np.sort(np.unique(content, return_index=True)[1])]
                for lo in range(0, len(starts), LOOKUPS):
                    part = starts[lo : lo + LOOKUPS]
                    if first_only and not len(part := part[~done[row_of[part]]]):
                        continue
                    for w, place, distance in zip(*(x.tolist() for x in size.probe(simhash(grams, part, n))), strict=True):
                        start, item = int(part[w]), int(size.items[place])
                        if first_only and done[row_of[start]]:
                            continue
                        own, counts = np.unique(grams[start : start + n], return_counts=True)
                        other, others = index.counts[item]
                        at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                        both = int(np.minimum(counts, others[at])[other[at] == own].sum())
                        similarity = both / (n + size.m - both)
                        if similarity >= SIMILARITY:
                            row = int(row_of[start])
                            done[row] = True
                            new = (similarity, -start, n + k - 1, distance)
                            best[row, item] = max(best.get((row, item), new), new)
    return [(row, item, -s - int(words.first[row]), window, distance, x) for (row, item), (x, s, window, distance) in best.items()]


def passes(benchmark: DataFrame, items: int = ITEMS, size: int = BYTES) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of the benchmark's (item_id, text) in lots of bounded count and bytes, sent to all executors one after the other; and
    whether there are several, so that the caller must be done with one when it asks for the next."""
    spark = benchmark.sparkSession
    table = stage(benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct())
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    lots = max(1, -(-2 * n // items), -(-2 * total // size)) if n > items or total > size else 1
    for lot in range(lots):
        part = table.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == lot) if lots > 1 else table
        held = spark.sparkContext.broadcast(Index(sorted((r.item_id if r.item_id is not None else -1, r.text) for r in part.collect())))
        yield held, lots > 1
        if lots > 1:
            held.unpersist()


LEAK = "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double"
LEAK_NAMES = ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"]


def leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, similarity: the best window of each document for each item it holds.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, shingles 5 words (an item or document with fewer: all its words), similarity
    0.8 or more; ties go to the first window. Null and wordless texts and items match nothing; a null item_id shows as -1,
    a null doc_id as null; repeated documents match each for itself, items equal in id and text once, other items that share an id
    or a text each for itself. Texts of any length are read whole. Empty tables give no rows; other columns are ignored, whatever
    their names. A benchmark of over `items` items (or 16 MB) is matched in lots, each lot's rows written before the next.
    """
    out = None
    for held, several in passes(benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in slices(batches, "text"):
                found = find(index, column(batch, "text"))
                ids = column(batch, "doc_id").to_pylist()
                rows = [(ids[r], index.ids[i], start, n, d, x) for r, i, start, n, d, x in found]
                types = [pa.int64()] * 5 + [pa.float64()]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], LEAK_NAMES)

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LEAK)
        part = stage(part) if several else part
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of docs that hold no benchmark item as in `leaks`, all columns unchanged: null and wordless texts and null doc_ids stay,
    repeated rows go or stay together, an empty benchmark drops nothing, an empty table gives no rows."""
    for held, several in passes(benchmark, items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in find(held.value, column(batch, "text"), first_only=True)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
        docs = stage(docs) if several else docs
    return docs


def op4(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("distance")  # a matter of the hash, which SQL can't repeat


#: Windows that share a shingle with an item, their weighted similarity, the first best.
OP4_SQL = r"""
with lowered as (
  select 'd' as kind, doc_id as id, text from documents union all select 'b', item_id, text from benchmark),
words as (
  select kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from lowered),
places as (select kind, id, len(w) as n, k, p, array_to_string(w[p:p + k - 1], ' ') as g
  from words, unnest(case when kind = 'b' then [least(len(w), 5)] else [1, 2, 3, 4, 5] end) as t(k), unnest(range(1, len(w) - k + 2)) as u(p)
  where len(w) >= k and k >= 1 and (kind = 'b' or k = 5 or k in (select least(len(w), 5) from words where kind = 'b'))),
items as (select id, n, k, g, count(*) as c from places where kind = 'b' group by all),
near as (select distinct d.id as doc_id, i.id as item_id, d.p, d.n as doc_words, i.n as item_words, d.k
  from places d join items i on d.k = i.k and d.g = i.g where d.kind = 'd'),
windows as (select distinct doc_id, item_id, k, least(item_words, doc_words) as size, item_words, s
  from near, unnest(range(greatest(1, p - (least(item_words, doc_words) - k)), least(p, doc_words - least(item_words, doc_words) + 1) + 1)) as t(s)),
counted as (select w.doc_id, w.item_id, w.k, w.s, w.size, w.item_words, d.g, count(*) as c
  from windows w join places d on d.kind = 'd' and d.id = w.doc_id and d.k = w.k and d.p between w.s and w.s + w.size - w.k group by all),
scored as (select doc_id, item_id, s, size, sum(least(x.c, i.c)) as both_c, any_value(size - x.k + 1 + item_words - x.k + 1) as total
  from counted x join items i on i.id = x.item_id and i.g = x.g and i.k = x.k group by doc_id, item_id, s, size),
good as (select *, both_c / (total - both_c) as similarity, row_number() over (partition by doc_id, item_id order by both_c / (total - both_c) desc, s) as r
  from scored where both_c / (total - both_c) >= 0.8)
select doc_id, item_id, s - 1 as first_word, size as n_words, similarity from good where r = 1
"""
