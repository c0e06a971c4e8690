"""Isotonic fits in ranges against one pass over all cells, and knots as a table against numpy's interpolation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrow.operators import calibrate


def one_pass(y, p):
    cells = pd.DataFrame({"p": p, "y": y}).groupby("p")["y"].agg(["sum", "count"]).reset_index()
    return calibrate.pool_adjacent(*(cells[c].to_numpy(float) for c in ("p", "p", "sum", "count")))


def blocks_of(spark, y, p, each):
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p})).repartition(3)
    out = calibrate.isotonic_blocks(df, each)
    return df, out, out.orderBy("x0").toPandas()


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "sweep"])
def test_ranges_give_the_blocks_of_one_pass(spark, kind):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(1500), 3)
    y = {"noise": rng.random(1500) < p, "falling": rng.random(1500) > p, "rising": p > 0.5, "sweep": p < 0.05}[kind].astype(int)
    _, _, got = blocks_of(spark, y, p, 60)
    want = one_pass(y, p)
    assert got[["x0", "x1", "pos", "n"]].values.tolist() == want.values.tolist()


def test_ranges_stay_bounded_when_every_score_is_a_block(spark):
    """Scores that are calibrated already aren't pooled: no range grows, and no round is needed."""
    n = 4000
    df = spark.range(n).select((F.col("id") / n).alias("p"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("k")).select("p", (F.col("k") < 1).cast("int").alias("y")).where("p < 0.05")
    rising = df.select(F.col("p"), (1 - F.col("y")).alias("y"))  # k of k + 1 at the k-th score
    out = calibrate.isotonic_blocks(rising, 30)
    sizes = [r["n"] for r in out.groupBy("r").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200 and max(sizes) <= 60 and len(sizes) >= 5


def test_knots_as_a_table(spark):
    rng = np.random.default_rng(6)
    x = np.unique(np.round(rng.random(700), 4))
    y = np.sort(rng.random(len(x)))
    p = np.concatenate([np.round(rng.random(2000) * 1.4 - 0.2, 4), np.full(1500, 0.25), x[:50]])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(p)), "p": p})).unionByName(spark.createDataFrame([(-1, None)], "i long, p double")).repartition(4)
    table = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    got = {r.i: r.p_cal for r in calibrate.interpolated(df, table, each=90).collect()}
    assert got.pop(-1) is None and len(got) == len(p)
    assert [got[i] for i in range(len(p))] == pytest.approx(np.interp(p, x, y).tolist(), abs=1e-12)


def test_many_knots_choose_the_table(spark, monkeypatch):
    rng = np.random.default_rng(7)
    p = rng.random(400)
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(400), "y": (rng.random(400) < p**2).astype(int), "p": p, "fold": np.arange(400) % 2}))
    few = calibrate.fit_isotonic(df)
    many = calibrate.fit_isotonic(df, most_knots=3)
    assert isinstance(few, calibrate.Calibrator) and isinstance(many, calibrate.KnotTable)
    a, b = ({r.row_id: r.p_cal for r in calibrate.calibrated(df, c).collect()} for c in (few, many))
    assert a == pytest.approx(b, abs=1e-12)
    small = {r.row_id: r.p_cal for r in calibrate.cross_fit(df, "isotonic").collect()}
    monkeypatch.setattr(calibrate, "fit", lambda scored, method: calibrate.fit_isotonic(scored, 3))
    assert {r.row_id: r.p_cal for r in calibrate.cross_fit(df, "isotonic").collect()} == pytest.approx(small, abs=1e-12)
