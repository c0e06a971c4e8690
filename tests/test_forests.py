"""Trees grown on Spark against the trainer that holds its table, their cuts, and training beyond its limit."""

import numpy as np
import pandas as pd
import pytest

from marrow.operators import boosting, forests, resample
from marrow.plans import train as training


def table(n, seed, values=40, k=5, missing=0.1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, values, (n, k)).astype(float) / 4
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + (x[:, 2] > 5) * 2)))).astype(int)
    x[rng.random((n, k)) < missing] = np.nan
    return x, y


def frame(spark, x, y, parts=3):
    data = pd.DataFrame(x, columns=[f"x{j}" for j in range(x.shape[1])]).astype(object).where(~np.isnan(x), None)
    schema = "row_id long, y int, " + ", ".join(f"{c} double" for c in data.columns)
    return spark.createDataFrame([(i, int(v), *r) for i, (v, r) in enumerate(zip(y, data.values.tolist()))], schema).repartition(parts), list(data.columns)


def same(a, b, places=5):
    assert a.base == pytest.approx(b.base) and len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees):
        assert [n[:5] for n in s] == [n[:5] for n in t]
        assert [n[5] for n in s] == pytest.approx([n[5] for n in t], abs=10**-places)


def test_trees_equal_those_of_the_small_trainer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(forests, "KEPT", 2)
    x, y = table(900, 3)
    df, names = frame(spark, x, y)
    fits = [forests.Fit(3, 3, 0.3), forests.Fit(2, 4, 0.1, "row_id % 3 <> 0"), forests.Fit(0, 1, 0.5), forests.Fit(2, 1, 0.5, "row_id < 0")]
    grown, margins = forests.fit(df, names, fits, str(tmp_path), ["row_id"])
    use = np.arange(900) % 3 != 0
    # The small trainer takes its cuts from the rows that it sees, so all values have to occur among them.
    same(grown[0], boosting.fit_forest(x, y, 3, 3, 0.3, tuple(names)))
    same(grown[1], boosting.fit_forest(x[use], y[use], 2, 4, 0.1, tuple(names)))
    same(grown[2], boosting.fit_forest(x, y, 0, 1, 0.5, tuple(names)))
    assert grown[3].trees == () and grown[3].base == 0.5
    got = {r.row_id: r.margins for r in margins.collect()}
    assert len(got) == 900
    for i in (0, 1):
        assert [got[r][i] for r in range(900)] == pytest.approx(boosting.margins(grown[i], x).tolist(), abs=1e-9)


def test_trees_do_not_depend_on_partitions(spark, tmp_path):
    x, y = table(400, 5)
    df, names = frame(spark, x, y, 1)
    one, _ = forests.fit(df, names, [forests.Fit(3, 2, 0.3)], str(tmp_path / "a"), ["row_id"])
    two, _ = forests.fit(df.repartition(5, "x0"), names, [forests.Fit(3, 2, 0.3)], str(tmp_path / "b"), ["row_id"])
    assert one == two


def test_cuts_of_few_and_of_many_values(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    many = rng.exponential(size=n)
    df = spark.createDataFrame(pd.DataFrame({"few": rng.integers(0, 200, n) / 8, "many": many, "gone": [float("nan")] * n, "one": [3.0] * n, "edge": np.arange(n) % 256 / 2})).repartition(6)
    cuts = {r.feature: np.array(r.cuts) for r in forests.cut_table(df, ["few", "many", "gone", "one", "edge"]).collect()}
    for j, name in ((0, "few"), (4, "edge")):
        want = boosting._bins(np.array([[r[0]] for r in df.select(name).collect()], np.float32))[0]
        assert cuts[j].tolist() == want.tolist()
    assert len(cuts[2]) == 0 and len(cuts[3]) == 0 and len(cuts[1]) >= 250
    # A cut lies between the values of two neighbouring ranks, each off by the sketch's error at most.
    ranks, error = np.searchsorted(np.sort(many), cuts[1]) / n, 1 / forests.ACCURACY + 1 / n
    assert len(cuts[1]) == 255
    assert (ranks >= np.arange(255) / 255 - error).all() and (ranks <= np.arange(1, 256) / 255 + error).all()


def test_training_goes_on_beyond_the_small_trainer(spark, monkeypatch):
    """The same folds, choice, trees and cover of all rows where the table may not be held in a task."""
    x, y = table(600, 11, missing=0.0)
    df, names = frame(spark, x, y)
    grid = ((1, 1, 0.1), (2, 3, 0.3))
    small = training.train(df, names, grid=grid)
    held, real = [], boosting.table_of
    monkeypatch.setattr(boosting, "table_of", lambda df, *a, **k: held.append(df.count()) or real(df, *a, **k))
    monkeypatch.setattr(boosting, "MOST_ROWS", 500)
    monkeypatch.setattr(training, "SEARCH_ROWS", 90)
    large = training.train(df, names, grid=grid)
    assert held == [training.OUTER * 90]  # the search's sample, whatever the table's size
    assert large.settings == small.settings == (2, 3, 0.3)
    same(large.forest, small.forest)
    a, b = ({r.row_id: (r.fold, r.y, r.p) for r in f.oof.collect()} for f in (small, large))
    assert a.keys() == b.keys() and all(a[i][:2] == b[i][:2] for i in a)
    assert [a[i][2] for i in a] == pytest.approx([b[i][2] for i in a], abs=1e-4)
