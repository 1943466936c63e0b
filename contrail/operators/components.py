"""Leading principal components of wide vectors by a block Krylov sketch: no matrix of width times width exists anywhere.

A pass multiplies the covariance by a few vectors at a time: tasks sum their rows' share (width x block numbers), partial sums are combined before and in the shuffle by pieces of the
width, and the width x block result reaches the driver. The vectors of all passes span a space in which the components are found; it grows until they don't change, or until it is the whole space.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions that one row of a partial sum holds.
PIECE = 256


class Components(NamedTuple):
    n: int
    mean: np.ndarray
    vectors: np.ndarray  # width x k, unit columns
    shares: np.ndarray  # of the variance, largest first


def covariance_times(rows: DataFrame, mean: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Sum over rows(v) of (v - mean) (v - mean)' block."""
    width, count = block.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, count))
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                x = np.stack(pdf["v"].iloc[at : at + 256].to_numpy()) - mean
                total += x.T @ (x @ block)
        starts = range(0, width, PIECE)
        yield pd.DataFrame({"piece": list(starts), "values": [total[a : a + PIECE].ravel() for a in starts]})

    parts = rows.select("v").mapInPandas(partial, "piece int, values array<double>")
    summed = parts.groupBy("piece").agg(vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))
    found = sorted(((r["piece"], r["values"]) for r in summed.collect()), key=lambda r: r[0])  # width / PIECE rows
    return np.concatenate([np.array(v).reshape(-1, count) for _, v in found])


def leading_components(rows: DataFrame, k: int, block: int = 8, passes: int = 100, tolerance: float = 1e-10, seed: int = 3) -> Components:
    """The k leading components of rows(v array<double>), at least two rows of one width, to the tolerance (of the largest variance, as the error of each component).
    Each pass is a job over the rows; passes without end are an error, not a worse result."""
    head = rows.agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("mean"), vector_to_array(Summarizer.variance(array_to_vector("v"))).alias("spread")).first()
    n, mean, total = head["n"], np.array(head["mean"]), float(sum(head["spread"])) * (head["n"] - 1)
    width = len(mean)
    k = min(k, width)
    if total <= 0:
        return Components(n, mean, np.eye(width, k), np.zeros(k))
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, max(block, k + 4)))))[0]
    basis, images = np.empty((width, 0)), np.empty((width, 0))
    for _ in range(passes):
        image = covariance_times(rows, mean, new)
        basis, images = np.concatenate([basis, new], axis=1), np.concatenate([images, image], axis=1)
        inner = basis.T @ images
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = values[::-1][:k], inside[:, ::-1][:, :k]
        vectors = basis @ inside
        error = np.linalg.norm(images @ inside - vectors * values, axis=0)
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        new = u[:, s > 1e-13 * total][:, : width - basis.shape[1]]
        if new.shape[1] == 0 or len(values) == k and (error <= tolerance * values[0]).all():
            if len(values) < k:  # fewer dimensions with any variance
                vectors, values = np.pad(vectors, ((0, 0), (0, k - len(values)))), np.pad(values, (0, k - len(values)))
            return Components(n, mean, vectors / np.maximum(np.linalg.norm(vectors, axis=0), 1e-300), np.maximum(values, 0) / total)
    raise ValueError(f"{k} components not found in {passes} passes to {tolerance}: their variances lie too close together")
