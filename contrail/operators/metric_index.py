"""Blocks of vectors that can be ruled out: angles obey the triangle inequality, so angles to a few pivots bound the angle of any two vectors.

Every vector goes to the cell of its nearest pivot and, inside it, to a ring by the angle to that pivot; a block is a ring of bounded size. Of each block the least and
largest angle to every pivot are known; two blocks whose intervals lie further apart at some pivot than the angle asked for hold no pair of it. Pivots are
a few rows of a bounded sample, so what the driver and the tasks hold doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from contrail.functions.vectors import as_doubles
from contrail.sources.scratch import kept

#: Rows of one block (about); rows that pivots are chosen from; pivots at most; rows for a pivot.
BLOCK, SAMPLE, PIVOTS, PER_PIVOT = 2048, 4096, 128, 512
#: Angles are computed with a smaller error than this.
SLACK = 1e-6
#: Rows that meet others in one task, and products held at once.
LOT, CELLS = 32_768, 1 << 20
#: A lot of blocks is a share of the table, up to so many bytes of vectors.
LOTS, LOT_BYTES = 16, 32 << 20
#: Blocks whose ranges of angles a task holds at once.
HELD = 4096


class Index(NamedTuple):
    """rows: g (group), id, v, block; blocks: g, block, n, lo, hi (angles to each pivot), lot. block is null for zero vectors, whose similarity is 0 to all.

    Blocks of a group that follow each other share a lot: lots meet in tasks, so a row is sent once for each lot of its group and not once for each block."""

    rows: DataFrame
    blocks: DataFrame


def farthest_first(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to count unit vectors, each the one farthest from those before; copies of one aren't taken."""
    chosen = [0] if len(vectors) else []
    near = vectors @ vectors[0] if chosen else None
    while chosen and len(chosen) < count:
        i = int(np.argmin(near))
        if near[i] > 1 - 1e-9:
            break
        chosen.append(i)
        near = np.maximum(near, vectors @ vectors[i])
    return vectors[chosen]


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _from_pivots(rows: pa.Table, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of the rows' v to the pivots, and which v are zero."""
    v = matrix(rows["v"])
    size = np.linalg.norm(v, axis=1)
    return angles(v / np.where(size > 0, size, 1)[:, None], pivots) if len(pivots) else np.zeros((len(v), 1)), ~(size > 0)


def _lowest(rows: DataFrame, n: int) -> DataFrame:
    """About 2 * SAMPLE of n rows, those with the lowest hashes: the sample lies among them, and not every partition sends the driver as many rows as the sample has."""
    return rows.where(F.xxhash64("id") <= min((1 << 63) - 1, (1 << 64) * 2 * SAMPLE // max(1, n) - (1 << 63)))


def build(df: DataFrame, key: str, vector: str = "vector", group: str | None = None, block: int = BLOCK, pivots: int | None = None, lots: int | None = None) -> Index:
    """Of df's non-null vectors; written, as it is read several times. Lots have about `lots` rows, by default a share of the table. Runs when it is called."""
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.alias("g"), F.col(key).alias("id"), as_doubles(F.col(vector)).alias("v")).where("v is not null")
    n = rows.count()
    taken = _lowest(rows, n).orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toPandas()["v"]
    sample = np.stack(taken.to_numpy()) if len(taken) else np.empty((0, 1))
    length = np.linalg.norm(sample, axis=1)
    chosen = farthest_first(sample[length > 0] / length[length > 0][:, None], pivots or min(PIVOTS, max(1, n // PER_PIVOT)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, zero = _from_pivots(pa.Table.from_batches([batch]), chosen)
            cell = np.where(zero, -1, far.argmin(axis=1)).astype("int32")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far.min(axis=1))], [*batch.schema.names, "cell", "own"])

    kind = dict(rows.dtypes)
    # placed anew by each of its readers: angles to the pivots are never shuffled or written, and the tables that are joined to it are written, so their sizes are known
    placed = rows.mapInArrow(place, f"g {kind['g']}, id {kind['id']}, v array<double>, cell int, own double")
    # rings: equal shares of a cell's range of angles are told apart by approximate quantiles; a ring that copies of one vector fill is cut by a hash
    cells = placed.where("cell >= 0").groupBy("g", "cell").agg(F.count("*").alias("c"), F.percentile_approx("own", F.lit([i / 64 for i in range(1, 64)]), 1000).alias("q"))
    rings = F.least(F.ceil(F.col("c") / block), F.lit(64)).cast("int")
    cut_at = F.transform(F.sequence(F.lit(1), F.greatest(rings - 1, F.lit(1))), lambda i: F.get(F.col("q"), F.floor(i * 64 / rings).cast("int") - 1))
    cells = kept(cells.select(F.col("g").alias("cg"), F.col("cell").alias("cc"), F.when(rings > 1, cut_at).otherwise(F.array().cast("array<double>")).alias("cuts")))
    ring = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("own"))), F.lit(0)).alias("ring")
    ringed = placed.join(cells, F.col("g").eqNullSafe(F.col("cg")) & (F.col("cell") == F.col("cc")), "left").select("g", "id", "v", "cell", ring)
    sizes = kept(ringed.where("cell >= 0").groupBy(F.col("g").alias("sg"), F.col("cell").alias("sc"), F.col("ring").alias("sr")).agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias("parts")))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(0)
    name = F.when(F.col("cell") >= 0, F.concat_ws("/", "cell", "ring", part)).alias("block")
    out = ringed.join(sizes, F.col("g").eqNullSafe(F.col("sg")) & (F.col("cell") == F.col("sc")) & (F.col("ring") == F.col("sr")), "left")
    out = kept(out.select("g", "id", "v", name))
    places = range(max(1, len(chosen)))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.schema([("g", g_type), ("block", pa.string()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
        met: dict = {}
        for batch in batches:
            both = pa.Table.from_batches([batch])
            code: dict = {}
            codes = np.array([code.setdefault(k, len(code)) for k in zip(both["g"].to_pylist(), both["block"].to_pylist())])
            far, order = _from_pivots(both, chosen)[0], np.argsort(codes, kind="stable")
            at = np.searchsorted(codes[order], np.arange(len(code)))
            for k, n, lo, hi in zip(code, np.bincount(codes), np.minimum.reduceat(far[order], at), np.maximum.reduceat(far[order], at)):
                m, below, above = met.get(k, (0, lo, hi))
                met[k] = m + int(n), np.minimum(below, lo), np.maximum(above, hi)
            if len(met) > HELD:
                yield pa.RecordBatch.from_pylist([{"g": k[0], "block": k[1], "n": n, "lo": lo, "hi": hi} for k, (n, lo, hi) in met.items()], of)
                met = {}
        yield pa.RecordBatch.from_pylist([{"g": k[0], "block": k[1], "n": n, "lo": lo, "hi": hi} for k, (n, lo, hi) in met.items()], of)

    g_type = to_arrow_type(rows.schema["g"].dataType)
    shares = out.where("block is not null").select("g", "block", "v").mapInArrow(ranges, f"g {kind['g']}, block string, n long, lo array<double>, hi array<double>")
    blocks = shares.groupBy("g", "block").agg(
        F.sum("n").alias("n"), F.array(*(F.min(F.col("lo")[k]) for k in places)).alias("lo"), F.array(*(F.max(F.col("hi")[k]) for k in places)).alias("hi")
    )
    size = lots or max(1, min(-(-n // LOTS), LOT_BYTES // (8 * sample.shape[1])))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("block")) - F.col("n")  # one row a block
    return Index(out, kept(blocks.withColumn("lot", F.floor(before / size))))


def _apart() -> Column:
    """The least angle that rows of blocks a and b can have."""
    gaps = F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.greatest(F.array_max(gaps), F.lit(0.0))


def block_pairs(index: Index, angle: float | None = None) -> DataFrame:
    """g, a, b, la, lb (their lots), apart, pairs: blocks of a group that may hold a pair with at most this angle (None: all), themselves included, with how many pairs of rows they hold."""
    a, b = index.blocks.alias("a"), index.blocks.alias("b")
    met = a.join(b, F.col("a.g").eqNullSafe(F.col("b.g")) & (F.col("a.block") <= F.col("b.block")))
    pairs = F.when(F.col("a.block") == F.col("b.block"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n")).cast("long")
    own = (F.col(f"{x}.{c}").alias(n) for x, c, n in (("a", "g", "g"), ("a", "block", "a"), ("b", "block", "b"), ("a", "lot", "la"), ("b", "lot", "lb")))
    out = met.select(*own, _apart().alias("apart"), pairs.alias("pairs"))
    return out if angle is None else out.where(F.col("apart") <= angle + SLACK)


def meet(index: Index, pairs: DataFrame, compare, schema: str) -> DataFrame:
    """What compare(blocks, pairs) yields, as arrays under the schema with g before them, where two lots meet: blocks are (ids, unit vectors) by name, pairs are (apart, a, b,
    top) of those to be compared, nearest first; top is the column of `pairs` or None. A task holds two lots, of which only blocks that meet another one are sent, each once."""
    task = ["g", "la", "lb"]
    top = F.col("top") if "top" in pairs.columns else F.lit(None).cast("double")
    work = pairs.select(*task, "a", "b", "apart", top.alias("top"))
    sent = work.select(*task, F.explode(F.array("a", "b")).alias("block")).distinct().alias("p").join(index.rows.alias("r"), F.col("p.g").eqNullSafe(F.col("r.g")) & (F.col("p.block") == F.col("r.block")))
    sent = sent.select(*(F.col(f"p.{c}") for c in (*task, "block")), "id", "v")
    # the pairs of a block travel as one more row of it
    todo = work.groupBy(*task, F.col("a").alias("block")).agg(F.collect_list(F.struct("apart", "b", "top")).alias("todo"))
    both = sent.unionByName(todo, allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        lists = both.filter(pc.is_valid(both["todo"])).select(["block", "todo"]).to_pylist()
        rows = both.filter(pc.is_null(both["todo"]))
        named = rows["block"].combine_chunks().dictionary_encode()
        ids, v, code = rows["id"].to_numpy(), matrix(rows["v"]), named.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ids, v = ids[order], v[order]
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-10
        ends = np.cumsum(np.bincount(code, minlength=len(named.dictionary)))
        blocks = {name: (ids[a:b], v[a:b]) for name, a, b in zip(named.dictionary.to_pylist(), [0, *ends], ends)}
        for out in compare(blocks, sorted((x["apart"], y["block"], x["b"], x["top"]) for y in lists for x in y["todo"])):
            arrays = [pa.array(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(arrays[0]), kind), *arrays], ["g", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    kind = to_arrow_type(pairs.schema["g"].dataType)
    return both.groupBy(*task).applyInArrow(run, f"g {dict(pairs.dtypes)['g']}, {schema}")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows."""
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of one length are asked for")
    flat = column.combine_chunks().flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def above(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y and products of the rows whose product is larger than the threshold, a bounded number at a time; same: y is x, each pair once."""
    step = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), step):
        first = at if same else 0
        s = x[at : at + step] @ y[first:].T
        near = s > threshold
        i, j = np.divmod(np.flatnonzero(np.triu(near, 1) if same else near), max(1, s.shape[1]))
        if len(i):
            yield i + at, j + first, s[i, j]
