"""Buckets of running sums: in order of the scores, and even where scores crowd near 0 or 1."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.operators import metrics


def test_buckets_never_fall_as_scores_grow(spark):
    rng = np.random.default_rng(2)
    powers = 2.0 ** -np.arange(0, 70)
    near = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, 1)])
    scores = np.unique(np.clip(np.concatenate([[0.0, 5e-324], near, 1 - near, rng.random(2000), 10.0 ** -rng.uniform(0, 25, 2000)]), 0, 1))
    rows = spark.createDataFrame([(float(x),) for x in scores], "p double").select("p", metrics.score_bucket(F.col("p")).alias("b")).orderBy("p").collect()
    buckets = [r.b for r in rows]
    assert None not in buckets and buckets == sorted(buckets)
    outside = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,)], "p double").select(metrics.score_bucket(F.col("p")).alias("b")).collect()
    assert outside[0] == outside[1] and outside[2] == outside[3]


@pytest.mark.parametrize("crowded", ["low", "high", "log"])
def test_crowded_scores_spread_over_windows(spark, crowded):
    rng = np.random.default_rng(4)
    p = 10.0 ** rng.uniform(-12, -3, 20_000) if crowded == "log" else rng.random(20_000) * 0.001
    p = 1 - p if crowded == "high" else p
    y = (rng.random(20_000) < 0.1 + 0.5 * (np.argsort(np.argsort(p)) / 20_000)).astype(int)
    scored = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    largest = metrics.cells(scored).groupBy(metrics.score_bucket(F.col("p"))).count().agg(F.max("count")).first()[0]
    assert largest < 20_000 / 200  # one of a thousand equal widths would hold nearly all
    order = np.argsort(p, kind="stable")
    values, first = np.unique(p[order], return_index=True)
    negatives = np.concatenate([[0], np.cumsum(1 - y[order])])
    ends = np.append(first[1:], len(p))
    at = np.searchsorted(values, p[y == 1])
    wins = (negatives[first[at]] + negatives[ends[at]]).sum() / 2
    assert metrics.auc(scored).first()[0] == pytest.approx(wins / (y.sum() * (1 - y).sum()), abs=1e-12)
