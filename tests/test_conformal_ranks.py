"""Conformal thresholds equal the sorted rank, wherever scores crowd."""

import math

import numpy as np
import pytest

from marrow.operators import conformal


def ranked(y, p, alpha):
    s = np.sort(np.where(y == 1, 1.0 - p, 1.0 - (1.0 - p)))
    return s[min(len(s), math.ceil((len(s) + 1) * (1 - alpha))) - 1]


@pytest.mark.parametrize("crowded", ["even", "within a millionth", "one value", "neighbouring doubles", "tiny"])
def test_rank_is_exact_where_scores_crowd(spark, monkeypatch, crowded):
    monkeypatch.setattr(conformal, "MOST_ORDERED", 20)
    monkeypatch.setattr(conformal, "BUCKETS", 16)
    rng = np.random.default_rng(6)
    p = {
        "even": rng.random(3000),
        "within a millionth": 0.3 + 1e-6 * rng.random(3000),
        "one value": np.full(3000, 0.25),
        "neighbouring doubles": 0.3 + 2.0**-54 * rng.integers(0, 40, 3000),
        "tiny": 10.0 ** -rng.uniform(0, 15, 3000),
    }[crowded]
    p[:5] = [0.0, 1.0, 0.5, 0.9999, 1e-300]
    y = rng.integers(0, 2, 3000)
    scored = spark.createDataFrame(list(zip(y.tolist(), p.tolist())) + [(None, 0.5), (1, None)], "y int, p double")
    for alpha in (0.05, 0.5, 0.9):
        assert conformal.q_hat(scored, alpha).first()[0] == ranked(y, p, alpha)


def test_no_rows_and_refused_scores(spark):
    rows = spark.createDataFrame([(1, 0.5)], "y int, p double")
    assert conformal.q_hat(rows).first()[0] == 0.5
    assert conformal.q_hat(rows.limit(0)).first()[0] is None
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            conformal.q_hat(rows.unionByName(spark.createDataFrame([(0, bad)], "y int, p double")))
