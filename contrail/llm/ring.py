"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

A document's place on the ring is the hash of its text, so equal texts lie together; it goes to the next virtual node
clockwise. Shards have row capacities that add up to the table (n/shards, one more for the first n mod shards). All
keys of an arc (the stretch before a virtual node) meet the shards in the same order, so the walk is done on counts of arcs,
a table whose size depends on the ring alone: in round r every arc offers what it has left to its r-th shard clockwise,
which takes arcs in ring order until it is full. Documents are then numbered within their arc and cut by those counts.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrail.llm.common import count_at_most

SHARDS, NODES = 16, 32
#: An arc's documents are numbered in so many ranges of text hashes, and those of a common text in so many parts by doc_id.
SALTS = 64
#: A text is common if it has over 1/4096 of all rows and over a thousand; so there are at most 4096.
COMMON, LEAST_COMMON = 4096, 1000


def _points(spark, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; places are hashes as unsigned 63-bit numbers."""
    table = spark.range(shards * nodes).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.col("id")), 1).alias("place"), F.floor(F.col("id") / nodes).cast("int").alias("shard")
    )
    return sorted((r.place, r.shard) for r in table.collect())


def deal(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each arc the (shard, rows) it fills in order; counts and owners in ring order, capacities summing to the counts."""
    arcs = len(counts)
    ways = []
    for a in range(arcs):
        seen: dict[int, None] = {}
        for j in range(arcs):
            seen.setdefault(owners[(a + j) % arcs])
        ways.append(list(seen))
    left, room = list(counts), list(capacity)
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    for turn in range(len(capacity)):
        for a in range(arcs):
            if left[a] and turn < len(ways[a]) and room[ways[a][turn]]:
                shard = ways[a][turn]
                got = min(left[a], room[shard])
                left[a] -= got
                room[shard] -= got
                out[a].append((shard, got))
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, salts: int = SALTS) -> DataFrame:
    """docs(doc_id, text, ..) with size, text_crc32, law (`rows`), shard, slot, grown_shard (null) added.

    Counts of shards differ by at most one; slots run from 0 without gaps in each shard. Size: UTF-8 bytes plus 1 (null text:
    1). Equal texts lie at one place of the ring and next to each other there, so that at most one group of them parts where a
    shard fills up. Order within an arc follows hashes of text and doc_id; rows equal in both are interchangeable. Null doc_ids
    and texts are hashed as such; texts of any length are measured whole. Columns with the added names are replaced. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    points = _points(spark, shards, nodes)
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    # an arc's number is the count of virtual nodes at or before the place
    arc = count_at_most([p for p, _ in points], place) % F.lit(len(points))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.withColumns({"size": F.octet_length(raw).cast("long") + 1, "text_crc32": F.crc32(raw), "__ring_arc": arc.cast("int"), "__ring_order": F.xxhash64("text", F.lit(3))})
    often = max(docs.count() / COMMON, LEAST_COMMON)
    common = keyed.groupBy("__ring_order").agg(F.count("*").alias("__ring_often")).where(F.col("__ring_often") > often)
    keyed = keyed.join(F.broadcast(common), "__ring_order", "left")
    # salts 0 to salts-1 are ranges of the order, whose texts stay together; those of common texts come behind their range's
    near = F.floor(F.pmod(F.shiftrightunsigned("__ring_order", 1), F.lit(1 << 62)) / ((1 << 62) / salts))
    own = F.when(F.col("__ring_often").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(salts)))
    keyed = keyed.withColumn("__ring_salt", (near * (salts + 1) + own).cast("int"))
    counted = {(r["__ring_arc"], r["__ring_salt"]): r["n"] for r in keyed.groupBy("__ring_arc", "__ring_salt").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    arcs: dict[int, list[int]] = {}
    for a, s in sorted(counted):
        arcs.setdefault(a, []).append(s)
    counts = [sum(counted[a, s] for s in arcs.get(a, ())) for a in range(len(points))]
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    cells: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for a, pieces in enumerate(deal(counts, [s for _, s in points], capacity)):
        # pieces of the arc as (first rank, shard, slot less rank)
        first, cuts = 0, []
        for shard, n in pieces:
            cuts.append((first, shard, filled[shard] - first))
            first += n
            filled[shard] += n
        start = 0
        for s in arcs.get(a, ()):
            n = counted[a, s]
            i = bisect.bisect_right([c[0] for c in cuts], start) - 1
            cells[a, s] = [(max(f - start, 0), shard, shift + start) for f, shard, shift in cuts[i:] if f < start + n]
            start += n
    rows = [(a, s, p) for (a, s), p in cells.items()]
    table = spark.createDataFrame(rows, "__ring_arc int, __ring_salt int, __ring_pieces array<struct<first:long,shard:int,shift:long>>")
    rank = F.row_number().over(Window.partitionBy("__ring_arc", "__ring_salt").orderBy("__ring_order", "doc_id", "text_crc32")) - 1
    dealt = keyed.select(*docs.columns, "size", "text_crc32", "__ring_arc", "__ring_salt", "__ring_order").withColumn("__ring_rank", rank.cast("long"))
    dealt = dealt.join(F.broadcast(table), ["__ring_arc", "__ring_salt"])
    piece = F.element_at(F.filter("__ring_pieces", lambda p: p["first"] <= F.col("__ring_rank")), -1)
    return dealt.select(
        *docs.columns,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        piece["shard"].alias("shard"),
        (piece["shift"] + F.col("__ring_rank")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).drop("text")
