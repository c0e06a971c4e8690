"""Intervals of the four metrics: points and replicates against brute force, buckets, keys, one class, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.operators import metrics

SCHEMA = "g string, y int, p double"


def table(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([("ab"[i % 2] if i % 3 else None, int(y[i]), float(p[i])) for i in range(n)], SCHEMA)


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ap = sum((pos == s).sum() / len(pos) * (pos >= s).sum() / (p >= s).sum() for s in set(p))
    at = sum((i * 0.1 <= p).astype(int) for i in range(1, 10))
    ece = sum((at == i).sum() / len(p) * abs(p[at == i].mean() - y[at == i].mean()) for i in set(at))
    return dict(zip(metrics.METRICS, (auc, ap, np.mean((p - y) ** 2), ece)))


@pytest.mark.parametrize("cells_each", [metrics.CELLS, 7])
def test_points_and_bounds_against_drawing_rows(spark, cells_each):
    df = table(spark)
    rows = df.select("y", "p").toPandas()
    y, p = rows["y"].to_numpy(), rows["p"].to_numpy()
    found = {r.metric: r for r in metrics.bootstrap(df, n_boot=1500, cells_each=cells_each).collect()}
    point = brute(y, p)
    rng, ones, zeros, draws = np.random.default_rng(5), np.flatnonzero(y == 1), np.flatnonzero(y == 0), []
    for _ in range(500):
        at = np.concatenate([rng.choice(ones, len(ones)), rng.choice(zeros, len(zeros))])
        draws.append(brute(y[at], p[at]))
    for m in metrics.METRICS:
        assert found[m].point == pytest.approx(point[m], abs=1e-12)
        low, high = np.percentile([d[m] for d in draws], [2.5, 97.5])
        assert (found[m].lo, found[m].hi) == pytest.approx((low, high), abs=0.25 * (high - low))


def test_partitions_and_parallelism_change_nothing(spark):
    df = table(spark)
    rounded = lambda d: [(r.metric, round(r.point, 10), round(r.lo, 10), round(r.hi, 10)) for r in metrics.bootstrap(d, n_boot=100, cells_each=9).collect()]
    assert rounded(df) == rounded(df.repartition(7)) == rounded(df.coalesce(1))


def test_keys_are_resampled_apart_null_among_them(spark):
    df = table(spark)
    found = {(r.g, r.metric): r for r in metrics.bootstrap(df, ["g"], n_boot=60, cells_each=20).collect()}
    assert len(found) == 12
    for g in ("a", "b", None):
        rows = df.where(F.col("g").eqNullSafe(F.lit(g))).toPandas()
        for m, value in brute(rows["y"].to_numpy(), rows["p"].to_numpy()).items():
            r = found[g, m]
            assert r.point == pytest.approx(value, abs=1e-12) and r.lo <= r.hi


def test_one_class_no_rows_and_missing_values(spark):
    one = {r.metric: r for r in metrics.bootstrap(spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7), ("a", None, 0.1), ("a", 0, None)], SCHEMA), n_boot=20).collect()}
    assert one["roc_auc"].point is None and one["pr_auc"].lo is None and one["brier"].point == pytest.approx((0.25 + 0.09) / 2)
    empty = metrics.bootstrap(spark.createDataFrame([], SCHEMA), n_boot=20).collect()
    assert [r.metric for r in empty] == list(metrics.METRICS) and all(r.point is None and r.lo is None for r in empty)
    assert metrics.bootstrap(spark.createDataFrame([], SCHEMA), ["g"], n_boot=20).count() == 0


def test_audit_with_intervals(spark):
    df = table(spark).unionByName(spark.createDataFrame([("small", 1, 0.5)], SCHEMA))
    rows = {r.g: r for r in metrics.subgroup_audit(df, "g", n_boot=50).collect()}
    assert set(rows) == {"a", "b", None, "small"} and rows["small"].auc_lo is None
    assert all(rows[g].auc_lo <= rows[g].auc <= rows[g].auc_hi for g in ("a", "b", None))
