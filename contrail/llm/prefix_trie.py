"""Prefix trie of conversations without a trie: sorted sequences, the common prefixes of neighbours, and range minima over them.

Conversations become sequences of 128-bit turn digests; equal ones are one sequence with a count. Sequences are range-sorted over the cluster. Inside a range, every
distinct prefix is a candidate (first sequence that has it, depth); its members lie side by side, as far to the left and right as the common prefix of
neighbours stays that long. A sparse table of range minima lets each candidate find both ends by binary search, all independently of each other. What a node sums over its
subtree lies in one piece behind it, since candidates are numbered in the order of a walk through the trie. A prefix of a range's first or last sequence may go on in
the next range: such open nodes come out as parts, which are added up by the digest of their prefix, and their subtree sums climb up by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import CRC32_SQL, WORD, column, mix, stage

_UP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    np.multiply.accumulate(out, out=out)
    return out


def prefix_keys(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each prefix of each sequence, the empty ones too: for a sequence of n turns n + 1 pairs, all in a row.

    a, b: the turns' two digests of all sequences in a row; start: where each sequence starts, and the end."""
    sizes = np.diff(start)
    depth = np.arange(len(a)) - np.repeat(start[:-1], sizes)
    longest = int(sizes.max()) if len(sizes) else 0
    out = []
    for values, base in ((a, _UP[0]), (b, _UP[1])):
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(values * _powers(base, longest)[depth] if longest else values, out=total[1:])
        # prefix sums from each sequence's start, with its empty prefix before them
        at = np.arange(len(a) + len(sizes)) - np.repeat(np.arange(len(sizes)), sizes + 1)
        here = np.repeat(total[start[:-1]], sizes + 1)
        d = at - np.repeat(start[:-1], sizes + 1)
        out.append(mix((total[at] - here) + d.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return out[0], out[1]


class Minima:
    """Range minima of values by a sparse table: a row for each power of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each place the largest end such that all values[at:end] are at least `least`: binary search from the longest step down."""
        end, n = at.copy(), len(self.rows[0])
        for level in range(len(self.rows) - 1, -1, -1):
            fits = end + (1 << level) <= n
            fits[fits] = self.rows[level][end[fits]] >= least[fits]
            end[fits] += 1 << level
        return end

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each place the smallest start such that all values[start:at] are at least `least`."""
        start = at.copy()
        for level in range(len(self.rows) - 1, -1, -1):
            fits = start >= 1 << level
            fits[fits] = self.rows[level][start[fits] - (1 << level)] >= least[fits]
            start[fits] -= 1 << level
        return start

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of each non-empty values[start:end]."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(level):
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.rows[k][start[i]], self.rows[k][end[i] - (1 << int(k))])
        return out


def common_prefixes(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """How many turns each sequence has in common with the next."""
    out = np.zeros(max(len(start) - 2, 0), np.int64)
    for i, (x, y, z) in enumerate(zip(start[:-2].tolist(), start[1:-1].tolist(), start[2:].tolist())):
        n = min(y - x, z - y)
        differ = (a[x : x + n] != a[y : y + n]) | (b[x : x + n] != b[y : y + n])
        out[i] = differ.argmax() if differ.any() else n
    return out


def nodes_of(a: np.ndarray, b: np.ndarray, start: np.ndarray, words: np.ndarray, copies: np.ndarray, smallest: np.ndarray) -> dict[str, np.ndarray]:
    """All nodes of one range of sorted distinct sequences, in the order of a walk. Of open nodes (prefixes of the first or the last sequence) the parts found here:
    children, leaves and saved words count closed nodes only."""
    count, sizes = len(start) - 1, np.diff(start)
    lcp = common_prefixes(a, b, start)
    table = Minima(lcp)
    # a prefix belongs to the first sequence that has it: depths over the common prefix with the sequence before; the root to the first of all
    before = np.concatenate([[-1], lcp])
    fresh = sizes - before
    owner = np.repeat(np.arange(count), fresh)
    first_node = np.concatenate([[0], np.cumsum(fresh)])
    depth = np.arange(len(owner)) - first_node[owner] + before[owner] + 1
    low, high = table.left(owner, depth), table.right(owner, depth)  # lcp[i] lies between sequences i and i + 1
    many = np.concatenate([[0], np.cumsum(copies)])
    n = many[high + 1] - many[low]
    conv = Minima(smallest).least(low, high + 1)
    is_open = (low == 0) | (high == count - 1)
    # a parent belongs to the leftmost sequence of its own interval
    up = np.maximum(depth - 1, 0)
    home = table.left(owner, up)
    parent = np.where(depth > 0, first_node[home] + up - before[home] - 1, -1)
    closed = ~is_open
    children = np.bincount(parent[closed & (depth > 0)], minlength=len(owner))
    last_words = np.zeros(len(owner), np.int64)
    inner = depth > 0
    last_words[inner] = words[start[owner[inner]] + depth[inner] - 1]
    leaf = np.where(closed & (children == 0), 1, 0)
    saved = np.where(closed, (n - 1) * last_words, 0)
    end = first_node[high + 1]  # nodes of the sequences up to high, all below this one
    sums = []
    for values in (leaf, saved):
        total = np.concatenate([[0], np.cumsum(values)])
        sums.append(total[end] - total[np.arange(len(owner))])
    k1, k2 = prefix_keys(a, b, start)
    key = start[owner] + owner + depth
    parent_key = np.where(depth > 0, key - 1, key)
    return {
        "k1": k1[key], "k2": k2[key], "p1": k1[parent_key], "p2": k2[parent_key], "depth": depth, "open": is_open, "conv_id": conv, "parent_conv_id": np.where(depth > 0, conv[parent], 0),
        "parent_open": np.where(depth > 0, is_open[parent], False), "n_convs": n, "n_children": children, "n_leaves": sums[0], "saved_tokens": sums[1], "last_words": last_words,
    }


SEQUENCES = "conv_id long, k1 long, k2 long, turns array<long>, words array<int>"
NODES = "k1 long, k2 long, p1 long, p2 long, depth long, open boolean, conv_id long, parent_conv_id long, parent_open boolean, n_convs long, n_children long, n_leaves long, saved_tokens long, last_words long"


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    own = column(batch, name)
    return own.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the whole sequence."""
    for batch in batches:
        if batch.num_rows:
            values, start = _lists(batch, "turns")
            start //= 2
            k1, k2 = prefix_keys(values[::2].view(np.uint64), values[1::2].view(np.uint64), start)
            whole = start[1:] + np.arange(batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), pa.array(k1[whole]), pa.array(k2[whole]), column(batch, "turns"), column(batch, "words")], ["conv_id", "k1", "k2", "turns", "words"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range is one task's rows, sorted."""
    parts = [(_lists(b, "turns"), _lists(b, "words")[0], column(b, "copies").to_numpy(), column(b, "conv_id").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    values = np.concatenate([p[0][0] for p in parts])
    start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[0][1]) for p in parts]))]) // 2
    words, copies, smallest = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2, 3))
    out = nodes_of(values[::2].view(np.uint64), values[1::2].view(np.uint64), start, words, copies, smallest)
    step = 1 << 16
    for a in range(0, len(out["k1"]), step):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + step]) for k, v in out.items()})


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) rows to texts of up to 65,536 ids of one sequence, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, ids = (column(batch, c).to_numpy() for c in ("k1", "k2", "conv_id"))
        cuts = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        ends = [*cuts[1:].tolist(), len(ids)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts.tolist(), ends)])], ["k1", "k2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each sequence in their order; only one text is held."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*(column(batch, c).to_pylist() for c in ("k1", "k2", "ids"))):
            if (k1, k2) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, turns (two digests for each turn), words of each conversation after it took the first h turns of conversation c - c mod group in
    place of its own, h = crc32(c) mod heads. heads = 1 leaves all as they are."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", F.xxhash64("text").alias("tie"))
    digest = F.struct(F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.regexp_count("text", F.lit(WORD)).alias("w"))
    own = rows.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), digest.alias("d")))), lambda x: x["d"]).alias("own"))
    own = stage(own)
    head = own.where(F.col("c") % group == 0).select(F.col("c").alias("base"), F.slice("own", 1, heads - 1).alias("head")) if heads > 1 else None
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    out = own.withColumns({"h": h.cast("int"), "base": F.col("c") - F.pmod("c", F.lit(group))})
    out = out.join(head, "base", "left") if head is not None else out.withColumn("head", F.lit(None).cast(own.schema["own"].dataType))
    tail = F.expr("slice(own, h + 1, greatest(size(own) - h, 0))")
    none = F.array().cast(own.schema["own"].dataType)
    all_ = F.concat(F.coalesce(F.expr("slice(head, 1, h)"), none), tail)
    out = out.select(F.col("c").alias("conv_id"), all_.alias("x"))
    return out.select("conv_id", F.flatten(F.transform("x", lambda t: F.array(t["a"], t["b"]))).alias("turns"), F.transform("x", lambda t: t["w"].cast("int")).alias("words"))


def _subtree_sums(opened: DataFrame) -> DataFrame:
    """Each open node with leaves and saved words of all open nodes below it, its own included. A round adds the sums of nodes 2^i levels below
    and doubles the step, so there are as many rounds as the depth has bits."""
    at = stage(opened.select("k1", "k2", "p1", "p2", "depth", F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")))
    deepest = at.agg(F.max("depth")).first()[0]
    step = 1
    while deepest is not None and step <= deepest:
        below = at.where(F.col("depth") >= step).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("l").alias("dl"), F.sum("s").alias("ds"))
        jump = at.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        new = at.join(below, ["k1", "k2"], "left").join(jump, ["p1", "p2"], "left")
        at = stage(new.select("k1", "k2", F.coalesce("q1", "p1").alias("p1"), F.coalesce("q2", "p2").alias("p2"), "depth", (F.col("l") + F.coalesce("dl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("ds", F.lit(0))).alias("s")))
        step *= 2
    return at.select("k1", "k2", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"))


#: Turns of one range, about.
RANGE = 1 << 19


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, per_range: int = RANGE) -> DataFrame:
    """One row for each node of the prefix trie of conversations(conv_id, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, ties by role and a hash of the text; null role or text is empty. Conversations are rebuilt first (see rebuilt). A node is a distinct
    sequence of the first d turns (role, text), the root has d = 0; members start with it. n_leaves counts childless nodes of the subtree, the node included; saved_tokens sums
    (n_convs - 1) * words of the last text over it; ends_sha256 is the SHA-256 of the comma-joined ids, ascending, of members that end there. Words are `[^\\x20\\x09-\\x0D]+`.

    Rows without a conv_id belong to no conversation and are left out; rows that are repeated are turns of their own; texts of any length are read whole; an
    empty table gives no rows; other columns are ignored, whatever their names. A conversation is one row of digests (20 bytes a turn), never of texts.
    Writes tables to the shared folder when it is called.
    """
    sequences = stage(rebuilt(conversations, group, heads).mapInArrow(_keyed, SEQUENCES))
    counted = sequences.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    distinct = sequences.join(counted, ["k1", "k2", "conv_id"]).select("conv_id", "turns", "words", "copies")
    turns = sequences.agg(F.sum(F.size("words"))).first()[0] or 0
    sorted_ = distinct.repartitionByRange(max(1, -(-turns // per_range)), "turns").sortWithinPartitions("turns")
    nodes = stage(sorted_.mapInArrow(_nodes, NODES))
    # open nodes: parts add up; open children are counted once the parts are one node
    opened = nodes.where("open").groupBy("k1", "k2").agg(
        *(F.first(c).alias(c) for c in ("p1", "p2", "depth", "last_words")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    )
    opened = stage(opened)
    beneath = opened.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    opened = opened.join(beneath, ["k1", "k2"], "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    # parts of nested open nodes hold the same closed nodes: only what is not below an open child is a node's own
    inner = nodes.where("open and depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("il"), F.sum("saved_tokens").alias("is"))
    own_leaf, own_saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("last_words")
    opened = opened.join(inner, ["k1", "k2"], "left").withColumns({"n_leaves": F.col("n_leaves") - F.coalesce("il", F.lit(0)) + own_leaf, "saved_tokens": F.col("saved_tokens") - F.coalesce("is", F.lit(0)) + own_saved}).drop("il", "is")
    opened = stage(opened)
    above = opened.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    whole = opened.drop("n_leaves", "saved_tokens").join(_subtree_sums(opened), ["k1", "k2"]).join(above, ["p1", "p2"], "left")
    whole = whole.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("up")))
    within = nodes.where("not open and not parent_open")
    border = nodes.where("not open and parent_open").drop("parent_conv_id").join(above, ["p1", "p2"], "left").withColumnRenamed("up", "parent_conv_id")
    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    all_ = within.select(columns).unionByName(border.select(columns)).unionByName(whole.select(columns))
    ends = sequences.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_joined_ids, "k1 long, k2 long, first long, ids string")
    ends = ends.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")
    return all_.join(ends, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))).drop("k1", "k2")


def op13(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Every prefix of every rebuilt conversation as a text of its turns' digests, grouped.
OP13_SQL = rf"""
with recursive own as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) as i, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
ids as (select distinct c from own), todo as (select c::varchar as x from ids), {CRC32_SQL},
heads as (select c, c - c % 20 as base, h % 4 as h from ids join sums on x = c::varchar),
rows as (
  select heads.c, i, role, text from heads join own on own.c = base where i <= h
  union all
  select heads.c, i, role, text from heads join own on own.c = heads.c where i > h),
turns as (
  select c, row_number() over (partition by c order by i) as d, md5(md5(role) || md5(text)) as t, length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w from rows),
paths as (
  select c, d, string_agg(t, '') over (partition by c order by d) as path, w from turns
  union all
  select c, 0, '', 0 from ids),
sizes as (select c, max(d) as most from paths group by c),
nodes as (
  select md5(path) as node, any_value(case when d > 0 then md5(path[:32 * (d - 1)]) end) as parent, any_value(d) as depth, min(c) as conv_id, count(*) as n_convs, any_value(w) as w,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = most), '')) as ends_sha256
  from paths join sizes using (c) group by path),
children as (select parent as node, count(*) as n_children from nodes where parent is not null group by parent),
full_nodes as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (node)),
below as (
  select node, parent as up, (n_children = 0)::int as leaf, (n_convs - 1) * w as saved, node as top from full_nodes
  union all
  select b.node, f.parent, leaf, saved, f.node from below b join full_nodes f on f.node = b.up),
totals as (select top as node, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from below group by top)
select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_nodes f join totals using (node) left join nodes p on p.node = f.parent
"""
