"""Removes words of 35-word windows that occur again: super-k-mers in buckets, counted exactly by sorting.

The packed strings of a bucket are turned into word numbers; windows get equal ranks exactly if their words are equal, by
sorting pairs of ranks of runs of 1, 2, 4, .. 32 words, and rank counts say which windows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contrail.llm.common import column
from contrail.llm.repeats import PACKED, Unit, mark_rows, remove_repeats

UNIT = Unit(words=True, length=35, gram=10)
#: Bytes of packed strings counted at once; cut between buckets only.
SHARD = 4 << 20


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.unique(high * (int(low.max()) + 1) + low, return_inverse=True)[1]


def window_ranks(ids: np.ndarray, length: int) -> np.ndarray:
    """A number for each run of `length` ids, equal exactly for equal runs."""
    rank, size = ids, 1
    while size < length:
        step = min(size, length - size)
        rank = _ranks(rank[:-step], rank[step:])
        size += step
    return rank


def _windows(string: bytes, n: int) -> list[bytes]:
    words = string.split(b" ")
    return [b" ".join(words[i : i + UNIT.length]) for i in range(n)]


def _count(rows: list[tuple]) -> pa.RecordBatch:
    """rows: PACKED rows of whole groups; a string counts as often as it occurs."""
    names: dict[bytes, int] = {b"": 0}
    ids: list[int] = []
    firsts = []
    for row in rows:
        firsts.append(len(ids))
        ids += [names.setdefault(w, len(names)) for w in row[6].split(b" ")]
    rank = window_ranks(np.array(ids, np.int64), UNIT.length)
    n = np.array([row[4] for row in rows])
    at = np.repeat(np.array(firsts) - np.cumsum(n) + n, n) + np.arange(n.sum())  # starts of all windows
    _, which = np.unique(rank[at], return_inverse=True)
    counts = np.bincount(which, weights=np.repeat([min(row[5], 2) for row in rows], n))
    masks = [np.packbits(x).tobytes() for x in np.split(counts[which] > 1, np.cumsum(n)[:-1])]
    return mark_rows(rows, masks, _windows)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in PACKED), strict=True):
            if size > SHARD and row[:2] != rows[-1][:2]:
                yield _count(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[6])
    if rows:
        yield _count(rows)


def substring_dedup(docs: DataFrame, part: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Each word goes that is covered by a 35-word window whose words start anywhere
    else too, in the same document or another; windows are judged on the input. Null, empty and shorter texts lose
    nothing; the digest is of the kept words joined by one space. Repeated rows count as documents of their own and so
    lose their windows; rows that share a doc_id and differ in text are judged apart. A text of any length is one document,
    handed out in bounded pieces. Null doc_ids are kept as they are; other columns are ignored, whatever their names; an empty
    table gives no rows. part: different strings of one anchor that one task counts.
    """
    out = remove_repeats(docs, UNIT, count_words, **({"part": part} if part is not None else {}))
    return out.select("doc_id", out.n_units.alias("n_words"), "n_removed", "kept_sha256")


def op8(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from words, unnest(range(1, len(w) - 33)) as t(i)),
again as (select h from windows group by h having count(*) > 1),
gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as p from windows join again using (h)),
lists as (select doc_id, list(p) as ps from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed,
  sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, j: not list_contains(ps, j)) end, ' ')) as kept_sha256
from words left join lists using (doc_id)
"""
