"""What the training-data operators share: the shared folder, Arrow slices of texts, and vectorised hashing of words and grams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of all contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where it is unset, a new temporary one serves executors that
    live in the driver's own process; on a cluster that is an error, as no executor could see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def stage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind a costly column once for use at several places of a lambda."""
    return F.transform(F.array(value), body)[0]


def count_at_most(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at or below the value, by halving."""
    if not cuts:
        return F.lit(0)
    array = F.lit(cuts).cast("array<long>") if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    lo, hi = F.lit(0), F.lit(len(cuts))
    state = F.struct(lo.alias("a"), hi.alias("b"))
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["a"] + s["b"], 1)
        right = (s["a"] < s["b"]) & (F.get(array, middle) <= value)
        left = (s["a"] < s["b"]) & ~right
        return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(left, middle).otherwise(s["b"]).alias("b"))

    return F.aggregate(steps, state, halve)["a"]


def row_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Two 64-bit hashes that identify a row by its id and text; equal rows share them and get equal results."""
    cs = [F.col(c) for c in cols]
    return df.withColumn("k1", F.xxhash64(*cs, F.lit(1))).withColumn("k2", F.xxhash64(F.lit(2), *reversed(cs)))


def slices(batches: Iterator[pa.RecordBatch], col: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one slice hold about `limit` bytes; one longer text makes a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(col))), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row (null: none) and each text's first offset, with the end as last."""
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(kind), b"" if kind == pa.large_binary() else "")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return data, off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[name] = have
    return have[:n]


class Rolling:
    """Polynomial hash mod 2^64 of any range of a unit sequence, from prefix sums; mixed afterwards."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * _power("up", _BASE, n), out=self.sums[1:])
        self.down = _power("down", _INVERSE, n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of units[start:end], the length mixed in."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of each run of k units."""
        m = self.n - k + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:m]) * self.down[:m] + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


_rng = np.random.default_rng(20240601)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_lower = _byte.copy()
_lower[65:91] = _byte[97:123]
_is_blank = np.zeros(256, bool)
_is_blank[[32, 9, 10, 11, 12, 13]] = True
_is_letter = np.zeros(256, bool)
_is_letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words:
    """The words of several texts: byte ranges, 64-bit hash (A-Z lower-cased if asked) and each text's first word.

    letters: words are runs of ASCII letters, digits and bytes beyond ASCII instead of runs without blanks.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, letters: bool = False):
        n = len(data)
        self.data, self.off = data, off
        word = _is_letter[data] if letters else ~_is_blank[data]
        border = np.zeros(n + 1, bool)
        border[off] = True
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= ~word[:-1] | border[1:n]
            last[:-1] &= ~word[1:] | border[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, off)
        self.lower = lower

    @cached_property
    def bytes(self) -> Rolling:
        return Rolling((_lower if self.lower else _byte)[self.data])

    @cached_property
    def hash(self) -> np.ndarray:
        return self.bytes.ranges(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def byte_units(data: np.ndarray) -> np.ndarray:
    return _byte[data]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; fewer words: the whole sequence as one; no word: none."""
    roll = Rolling(words.hash)
    grams = roll.grams(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(roll.ranges(np.array([a]), np.array([b])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    size, out = 1, values
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out


#: DuckDB: crc32 of each distinct UTF-8 text of todo(x) as sums(x, h). The table of 256 values comes from its rule.
CRC32_SQL = """
bits as (
  select i as v, i, 0 as k from range(256) r(i)
  union all
  select case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i, k + 1 from bits where k < 8),
crc_table as (select list(v order by i) as t from bits where k = 8),
steps as (
  select x, hex(encode(x)) as bytes, 0 as pos, 4294967295::bigint as h from (select distinct x from todo)
  union all
  select x, bytes, pos + 1, xor(h >> 8, (select t from crc_table)[(xor(h & 255, 16 * (strpos('0123456789ABCDEF', bytes[2 * pos + 1]) - 1) + strpos('0123456789ABCDEF', bytes[2 * pos + 2]) - 1) + 1)::int])
  from steps where 2 * pos < length(bytes)),
sums as (select x, xor(h, 4294967295) as h from steps where 2 * pos = length(bytes))"""
