"""Components by passes against the singular values of the whole matrix."""

import numpy as np
import pytest

from contrail.operators import components as c
from contrail.operators import vectors as v


def frame(spark, x):
    return spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)


def exact(x):
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return vt, s**2 / (s**2).sum()


@pytest.mark.parametrize("n,d,k", [(60, 20, 3), (12, 40, 5), (200, 700, 4), (5, 3, 3)])
def test_components_are_the_singular_vectors(spark, n, d, k):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) * (0.7 ** np.arange(d)) + 5
    vt, shares = exact(x)
    got = c.leading_components(frame(spark, x), k)
    assert got.n == n and np.allclose(got.mean, x.mean(axis=0))
    assert np.allclose(got.shares, shares[:k], atol=1e-9)
    assert np.allclose(np.abs(np.sum(got.vectors * vt[:k].T, axis=0)), 1, atol=1e-7)


def test_even_spectrum_takes_the_whole_space(spark):
    """Hardly a gap between variances: the space grows until nothing is left out."""
    x = np.random.default_rng(1).normal(size=(400, 30))
    vt, shares = exact(x)
    assert np.allclose(c.leading_components(frame(spark, x), 30).shares, shares, atol=1e-9)


def test_wide_vectors(spark, monkeypatch):
    """4,096 dimensions: nothing of width x width is formed (it would be 134 MB a task and on the driver)."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4096)) + np.outer(rng.normal(size=300) * 9, rng.normal(size=4096)) + np.outer(rng.normal(size=300) * 4, rng.normal(size=4096))
    monkeypatch.setattr(v, "PCA", None)
    df = frame(spark, x).withColumnRenamed("v", "vector")
    vt, shares = exact(x)
    first = np.array(v.pca_vector(df).first()["vector"])
    assert abs(first @ vt[0]) > 1 - 1e-9 and first @ x.mean(axis=0) >= 0
    found = [r["share"] for r in v.variance_explained(df, k=2).orderBy("component").collect()]
    assert np.allclose(found, shares[:2], atol=1e-9)


def test_constant_rows_have_no_variance(spark):
    got = c.leading_components(frame(spark, np.ones((4, 6))), 2)
    assert (got.shares == 0).all() and got.vectors.shape == (6, 2)
