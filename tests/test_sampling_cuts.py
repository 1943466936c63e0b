"""Cuts by counting against sorted order."""

import pytest
from pyspark.sql import functions as F

from contrail.operators import pairs
from contrail.operators import sampling as m


def order(i, seed):
    return ((seed * 7919 + i % m.MODULUS) * 104_729 + 13) % m.MODULUS, i


@pytest.mark.parametrize("ratio,max_rows", [(0.3, None), (0.001, None), (1.0, None), (2.0, 7), (0.9, 20)])
def test_subsample_is_the_head_of_the_order(spark, ratio, max_rows):
    """Keys that differ by the modulus share their place, so that cuts fall between ties."""
    keys = [i + j * m.MODULUS for i in range(40) for j in range(i % 5 + 1)]
    rows = [(k, None if k % 7 == 0 else k % 3) for k in keys]
    df = spark.createDataFrame(rows, "pos long, g int").repartition(3)
    for group in ([], ["g"]):
        got = m.subsample(df, ratio, 5, max_rows, group)
        assert got.columns == df.columns
        want = set()
        for g in {r[1] for r in rows} if group else {0}:
            own = sorted((r for r in rows if not group or r[1] == g), key=lambda r: order(r[0], 5))
            n = len(own) if ratio >= 1 else max(1, int(len(own) * ratio))
            want |= set(own[: min(n, max_rows or n)])
        have = [tuple(r) for r in got.collect()]
        assert set(have) == want and len(have) == len(want)


def test_nothing_to_sample(spark):
    df = spark.createDataFrame([], "pos long, g int")
    assert m.subsample(df, 0.5).collect() == m.subsample(df, 0.5, group=["g"]).collect() == []


def test_a_cut_writes_nothing(spark, monkeypatch):
    """Neither a table nor a sort of the rows by range."""
    monkeypatch.setattr(pairs, "kept", lambda df: pytest.fail("a table was written"))
    df = spark.range(5000).withColumnRenamed("id", "pos")
    out = m.subsample(df, 0.25)
    assert out.count() == 1250
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("quota", [1, 2, 499, 500, 501, 1000])
def test_cut(spark, quota):
    df = spark.range(1000).select((F.col("id") * 37 % 250).alias("v"))  # each value four times
    want = sorted(i * 37 % 250 for i in range(1000))[quota - 1]
    row = m.with_cut(df, [], F.col("v"), spark.createDataFrame([(quota,)], "_quota long"), 250).first()
    assert (row["_cut"], row["_left"]) == (want, quota - sum(i * 37 % 250 < want for i in range(1000)))


def test_hash_in_the_engine(spark):
    texts = ["", "0/a", "11/_general", "3/größe – ß", "7/日本", "x" * 300]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", m.text_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in got} == {t: m.hash_text(t) for t in texts}
