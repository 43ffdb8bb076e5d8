"""Operators over patients in blocks of time give what they give over whole patients."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, features, temporal


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        patient = "hot" if i % 2 else rng.choice(["a", "b", None])
        t = None if i % 97 == 0 else float(rng.randint(0, 400))
        rows.append((patient, t, i, rng.random() if rng.random() < 0.1 else None, "x" if rng.random() < 0.05 else None, i, "k"))
    return spark.createDataFrame(rows, "p string, t double, i long, v double, s string, _rn long, `d.o` string").repartition(5).cache()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("most", [40, 300])
def test_filled_in_blocks(hot, most):
    whole = features.fill_missing(hot, "p", ["t", "i"], ["v"], ["s"])
    assert whole.columns == hot.columns
    parts = features.fill_missing(hot, "p", ["t", "i"], ["v"], ["s"], block_rows=most)
    near = lambda df: rows_of(df.withColumn("v", F.round("v", 9)))
    assert near(parts) == near(whole) and len(blocks.cuts(hot, "p", F.col("t"), most)) > 1
    a, b = (rows_of(features.interpolate(hot, "p", ["t", "i"], "v", "w", block_rows=x).withColumn("w", F.round("w", 9))) for x in (most, None))
    assert a == b


@pytest.mark.parametrize("direction", ["nearest", "backward"])
def test_asof_in_blocks(hot, direction):
    at = hot.withColumn("t", F.timestamp_seconds("t")).where("t is not null")
    left, right = at.where("i % 3 = 0"), at.where("i % 3 = 1 and i < 700")
    of = lambda most: rows_of(temporal.asof(left, right, "p", "t", "v", "i", "i", direction, 30_000_000, block_rows=most))
    assert of(50) == of(None)


def test_blocks_spread_a_large_patient(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("p"), F.col("id").cast("double").alias("t"))
    at = blocks.cuts(df, "p", F.col("t"), 1000)
    sizes = [r["count"] for r in df.groupBy(blocks.block_of(F.col("t"), at).alias("b")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    assert blocks.cuts(df, "p", F.col("t"), 20_000) == [] and blocks.cuts(df.limit(0), "p", F.col("t"), 1) == [] and blocks.cuts(df, "p", F.col("t")) == []


def test_names_of_the_input_stay(spark):
    df = spark.createDataFrame([("a", i, float(i), i, i, i) for i in range(30)], "p string, t int, v double, _n int, _rn int, _block int")
    for made in (features.decay_accumulate(df, "p", ["t"], "v", "d"), features.every_nth(df, "p", ["t"], 3), features.first_n(df, "p", ["t"], 5), features.windows(df, "p", ["t"], ["v"], "v", 3, 1).drop("x", "y", "anchor"), features.fill_missing(df, "p", ["t"], ["v"], [])):
        assert set(df.columns) <= set(made.columns) and made.where("_n <> t or _rn <> t or _block <> t").count() == 0


def test_no_window_ends_at_the_last_row(hot):
    # Spark computes such frames anew for each row, so they cost the square of a patient's rows
    plan = features.fill_missing(hot, "p", ["t", "i"], ["v"], ["s"], block_rows=300)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$" in plan and "unboundedfollowing$" not in plan


def test_number_of_a_block(spark):
    cut = [float(c) for c in range(3, 60, 3)]
    rows = spark.createDataFrame([(None,), (float("nan"),), *[(x / 2,) for x in range(-2, 130)]], "t double")
    for ends in ([], cut[:1], cut[:7], cut[:8], cut):
        for r in rows.select("t", blocks.block_of(F.col("t"), ends).alias("b")).collect():
            assert r.b == (0 if r.t is None else len(ends) if r.t != r.t else sum(c < r.t for c in ends))


def test_filled_rows_with_their_number(hot):
    made = features.fill_missing(hot, "p", ["t", "i"], ["v"], ["s"], block_rows=300, number_as="n")
    assert [(r.i, r.n) for r in made.where("p = 'hot'").orderBy("n").collect()] == [(r.i, n + 1) for n, r in enumerate(hot.where("p = 'hot'").orderBy("t", "i").collect())]
