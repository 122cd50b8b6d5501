"""Draws of the bootstrap and of baskets are independent, spread and repeatable."""

import math

import numpy as np
from pyspark.sql import functions as F

from basketlab.functions.exprs import draw
from basketlab.operators.forward import block_start


def starts(spark, n, block, reps=2000):
    blocks = math.ceil(n / block)
    rows = (
        spark.range(reps)
        .select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        .select("rep", "b", block_start(F.col("rep"), F.col("b"), F.lit(n - block + 1)).alias("s"))
        .orderBy("rep", "b")
        .collect()
    )
    return np.array([r.s for r in rows]).reshape(reps, blocks)


def test_starts_are_near_uniform_and_gaps_vary(spark):
    s = starts(spark, 25, 3)
    share = np.bincount(s.ravel(), minlength=23) / s.size
    assert len(share) == 23 and abs(share * 23 - 1).max() < 0.25
    assert len({tuple(x) for x in s}) > 1990
    gaps = np.diff(s, axis=1)
    assert len(np.unique(gaps)) > 40


def test_spread_of_resampled_mean_agrees_with_independent_draws(spark):
    n, block = 60, 4
    x = np.random.default_rng(3).normal(size=n)
    sums = np.array([x[i : i + block].mean() for i in range(n - block + 1)])
    got = sums[starts(spark, n, block)].mean(axis=1).std()
    own = sums[np.random.default_rng(4).integers(0, n - block + 1, (20000, n // block))].mean(axis=1).std()
    assert abs(got / own - 1) < 0.05


def test_draws_repeat(spark):
    one = spark.range(5).select(draw(F.col("id"), 7, "x").alias("d")).collect()
    assert one == spark.range(5).select(draw(F.col("id"), 7, "x").alias("d")).collect()
    assert len({r.d for r in one}) == 5
