"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words (runs of letters and digits, A-Z lower-cased) and their first 4 and 5 bytes, hashed
into 2^22 places; presence counts, not frequency. A term's value is how far its share of toxic documents in the sample lies
from the sample's own, in standard errors: what all texts share counts for little, and no term is left out. The machine adds
to a linear score the interaction of every pair of terms present, as the product of two short vectors, so a word can count
only beside another. It is fitted by AdaGrad in batches on a bounded sample of labelled rows, both classes weighing alike;
scoring is one scan of all texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.llm.common import Words, column, packed, slices, stage

#: Places of the hashed terms, bytes of a word that make terms of their own, length of a term's vector.
PLACES, PREFIXES, FACTORS = 1 << 22, (4, 5), 4
#: Documents of either class, and different texts of them, that the machine is fitted on, the first by a hash of doc_id.
SAMPLE = 6000
EPOCHS, BATCH, RATE, DECAY, SEED = 5, 128, 0.05, 1e-3, 3


@dataclass(frozen=True)
class Machine:
    """places: sorted hashed terms; bias, weights and vectors of the machine, the terms' values multiplied in."""

    places: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all terms of the texts, with repeats."""
    words = Words(*packed(texts), lower=True, letters=True)
    rows = np.repeat(np.arange(len(texts)), np.diff(words.first))
    places, owners = [words.hash], [rows]
    for size in PREFIXES:
        long = words.end - words.start >= size
        places.append(words.bytes.ranges(words.start[long], words.start[long] + size) ^ np.uint64(size))
        owners.append(rows[long])
    return np.concatenate(owners), (np.concatenate(places) & np.uint64(PLACES - 1)).astype(np.int64)


def _collect_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows, places = terms(column(batch, "text"))
        both = np.unique(rows * PLACES + places)
        ends = np.searchsorted(both, np.arange(batch.num_rows + 1) * PLACES)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((both % PLACES).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([column(batch, "toxic"), column(batch, "doc_id"), lists], ["toxic", "doc_id", "terms"])


def fit(labels: np.ndarray, terms: np.ndarray, ends: np.ndarray) -> Machine:
    """labels 0/1; row i's terms are terms[ends[i]:ends[i + 1]], without repeats."""
    n, ones = len(labels), int(labels.sum())
    if not ones or ones == n or not len(terms):
        return Machine(np.empty(0, np.int32), math.log((ones + 0.5) / (n - ones + 0.5)), np.empty(0, np.float32), np.empty((0, FACTORS), np.float32))
    toxic = np.repeat(labels > 0, np.diff(ends))
    seen, hits = np.bincount(terms, minlength=PLACES), np.bincount(terms[toxic], minlength=PLACES)
    places = np.flatnonzero(seen).astype(np.int32)
    number = np.zeros(PLACES, np.int32)
    number[places] = np.arange(len(places))
    at = number[terms]
    expected = seen[places] * (ones / n)
    value = (np.abs(hits[places] - expected) / np.sqrt(expected * (1 - ones / n) + 1) / 3).astype(np.float32)
    del seen, hits, number, toxic, expected
    rng = np.random.default_rng(SEED)
    theta = np.zeros((len(places), 1 + FACTORS), np.float32)
    theta[:, 1:] = rng.normal(0, 0.02, (len(places), FACTORS))
    squares = np.full_like(theta, 1e-2)
    bias, bias_squares = 0.0, 1e-2
    full = np.flatnonzero(np.diff(ends))
    lots = -(-len(full) // BATCH)
    for _ in range(EPOCHS):
        full = rng.permutation(full)
        for lot in range(lots):
            rows = full[lot * BATCH : (lot + 1) * BATCH]
            mine = [at[ends[r] : ends[r + 1]] for r in rows]
            sizes = np.array([len(x) for x in mine])
            ids = np.concatenate(mine)
            row, starts = np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
            order = np.argsort(ids, kind="stable")
            used, first = np.unique(ids[order], return_index=True)
            x = value[ids][:, None]
            here = theta[ids] * x
            sums = np.add.reduceat(here, starts, axis=0)
            pairs = (sums[:, 1:] ** 2).sum(axis=1) - np.add.reduceat((here[:, 1:] ** 2).sum(axis=1), starts)
            guess = 1 / (1 + np.exp(-np.clip(bias + sums[:, 0] + 0.5 * pairs, -30, 30)))
            weight = np.where(labels[rows] > 0, 0.5 * n / ones, 0.5 * n / (n - ones)) / BATCH
            error = ((guess - labels[rows]) * weight).astype(np.float32)
            part = sums[row] - here
            part[:, 0] = 1
            part *= error[row][:, None] * x
            grad = np.add.reduceat(part[order], first, axis=0) + DECAY / lots * theta[used]
            squares[used] += grad**2
            theta[used] -= RATE * grad / np.sqrt(squares[used])
            g = float(error.sum())
            bias_squares += g * g
            bias -= RATE * g / math.sqrt(bias_squares)
    theta *= value[:, None]
    return Machine(places, bias, theta[:, 0].copy(), theta[:, 1:].copy())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on docs(doc_id, text) labelled in labels(doc_id, toxic), held-out ids left out; conflicting labels count as toxic."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")  # picked: at most 2 * sample rows
    # an id may have many rows: those with the same terms are one, and no more of the others than the sample holds are learned from
    table = texts.select("toxic", "doc_id", "text").mapInArrow(_collect_terms, "toxic int, doc_id long, terms array<int>").withColumn("h", F.xxhash64("terms"))
    table = stage(table.dropDuplicates(["doc_id", "h"]))
    keys = table.select("toxic", "doc_id", "h")  # the cut is found on these: terms never meet in one place before they are sent
    own = [keys.where(F.col("toxic") == c).orderBy(*order, "h").limit(sample).drop("toxic") for c in (1, 0)]
    table = table.join(F.broadcast(own[0].union(own[1])), ["doc_id", "h"])  # at most 2 * sample rows
    # the same machine whatever the order of rows; at most 2 * sample rows of at most PLACES terms
    table = table.orderBy("doc_id", "h").select("toxic", "terms").toArrow()
    if not table.num_rows:
        return fit(np.empty(0), np.empty(0, np.int32), np.zeros(1, np.int64))
    labels, lists = table.column("toxic").to_numpy().astype(np.float32), table.column("terms").combine_chunks()
    del table
    return fit(labels, lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64))


def scores(machine: Machine, texts: pa.Array) -> np.ndarray:
    out = np.full(len(texts), machine.bias)
    if len(machine.places):
        table = np.full(PLACES, -1, np.int32)
        table[machine.places] = np.arange(len(machine.places))
        rows, places = terms(texts)
        at = table[places]
        rows, at = rows[at >= 0], at[at >= 0].astype(np.int64)
        both = np.unique(rows * len(machine.places) + at)
        rows, at = both // len(machine.places), both % len(machine.places)
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        if len(starts):
            x = machine.vectors[at].astype(float)
            pairs = (np.add.reduceat(x, starts, axis=0) ** 2 - np.add.reduceat(x**2, starts, axis=0)).sum(axis=1)
            out[rows[starts]] += np.add.reduceat(machine.weights[at].astype(float), starts) + 0.5 * pairs
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text).

    score tells from the text alone how likely label 1 is where both labels are as frequent; null and empty texts get the bias's.
    Labels of held-out ids (crc32 of the id as text, modulo 5, is 0) are not learned from. Without labels of both classes the
    score is the share of toxic labels. Equal texts get equal scores, texts of any length are read whole; a null doc_id is not held
    out and has no label; of rows that share a labelled doc_id, different texts are all learned from as far as the sample goes. An empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores(held.value, column(batch, "text")))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs scored under the threshold, all columns unchanged; null and empty texts score as in `toxicity`, repeated rows
    go or stay together, an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(scores(held.value, column(batch, "text")) < threshold))

    return docs.select(*columns).mapInArrow(run, T.StructType(docs.schema.fields))


def op2(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
