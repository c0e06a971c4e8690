"""The search for settings uses all rows of an outer fold, in tasks and grown on Spark."""

import inspect

import numpy as np
import pandas as pd
import pytest

from marrow.operators import boosting, forests
from marrow.plans import train as training


def auc(y, p):
    above, below = p[y == 1], p[y == 0]
    return ((above[:, None] > below).mean() + (above[:, None] >= below).mean()) / 2


def test_search_in_tasks_uses_all_rows(spark, monkeypatch):
    n = 30_000  # an outer fold's rows are more than the former bound of 20,000
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "y": (rng.random(n) < 0.3).astype(int), "a": rng.random(n)}))
    asked = {}

    def seen(spark, table, features, specs, parts, *rest):
        asked.update(specs=specs, parts=parts, fold=table["fold"].to_numpy(), y=table["y"].to_numpy())
        raise InterruptedError

    monkeypatch.setattr(boosting, "fit_many", seen)
    with pytest.raises(InterruptedError):
        training.train(df, ["a"], grid=((1, 1, 0.1),))
    assert len(asked["specs"]) == len(asked["parts"]) == training.OUTER * training.INNER
    for i, (train, test) in enumerate(asked["parts"]):
        assert sorted([*train, *test]) == np.flatnonzero(asked["fold"] != i // training.INNER).tolist()
        assert abs(asked["y"][test].mean() - 0.3) < 0.02 and abs(len(train) - 2 * len(test)) <= 2


def test_fewer_rows_only_if_asked_for(spark, monkeypatch):
    n = 3_000
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "y": (rng.random(n) < 0.3).astype(int), "a": rng.random(n)}))
    asked = []

    def seen(spark, table, features, specs, parts, *rest):
        asked.extend(len(train) + len(test) for train, test in parts)
        raise InterruptedError

    monkeypatch.setattr(boosting, "fit_many", seen)
    for rows, most in ((None, 2400), (1000, 1000), (2400, 2400)):
        asked.clear()
        with pytest.raises(InterruptedError):
            training.train(df, ["a"], grid=((1, 1, 0.1),), search_rows=rows)
        assert asked == [most] * training.OUTER * training.INNER


def test_specs_that_differ_in_trees_are_one_fit(spark):
    rng = np.random.default_rng(6)
    table = pd.DataFrame(rng.integers(0, 30, (400, 3)).astype(float), columns=["a", "b", "c"])
    table["y"] = (table["a"] + rng.integers(0, 20, 400) > 25).astype(int)
    parts = [(np.arange(300), np.arange(300, 400)), (np.arange(400), np.arange(0))]
    specs = pd.DataFrame([(0, 2, 5, 0.3, 0), (1, 2, 2, 0.3, 0), (2, 2, 2, 0.1, 0), (3, 2, 4, 0.3, 1)], columns=training.SPEC)
    fits = boosting.fit_many(spark, table, ["a", "b", "c"], specs, parts)
    assert fits.rdd.getNumPartitions() == 3
    got = fits.toPandas()
    x, y = table[["a", "b", "c"]].to_numpy(np.float32), table["y"].to_numpy(float)
    for s in specs.itertuples():
        train, test = parts[s.part]
        own, want = got[got["spec"] == s.spec], boosting.fit_forest(x[train], y[train], s.depth, s.trees, s.rate, ("a", "b", "c"))
        if len(test):
            z = boosting.margins(want, x[test])
            assert own["position"].tolist() == test.tolist() and own["p"].tolist() == (1 / (1 + np.exp(-z))).tolist()
        else:
            assert boosting.pickle.loads(own["forest"].iloc[0]) == want


def test_search_grown_on_spark_uses_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n, names = 700, ["a", "b", "c"]
    x = rng.integers(0, 6, (n, 3)).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(3 - x[:, 0] - (x[:, 1] > 2) * (x[:, 2] > 2) * 2))).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "y": y, **dict(zip(names, x.T))})).repartition(3)
    grid = ((1, 1, 0.1), (2, 2, 0.3), (2, 3, 0.3))
    asked, real, chosen, best = [], forests.fit, [], training._best

    def seen(*args, **named):
        bound = inspect.signature(real).bind(*args, **named).arguments
        asked.append((bound["df"], bound["fits"]))
        return real(*args, **named)

    monkeypatch.setattr(boosting, "MOST_ROWS", 500)
    monkeypatch.setattr(boosting, "table_of", lambda *a, **k: pytest.fail("rows on the driver"))
    monkeypatch.setattr(forests, "fit", seen)
    monkeypatch.setattr(training, "_best", lambda *a: chosen.append(best(*a)) or chosen[-1])
    fitted = training.train(df, names, grid=grid)
    assert fitted.oof.count() == n
    rows, fits = asked[0]
    table = rows.toPandas()
    assert len(table) == n and len(fits) == training.OUTER * 2 * training.INNER  # two of the settings are one fit
    want = {}
    for k in range(training.OUTER):
        inside, inner = table["_outer"].to_numpy() != k, table[f"_inner{k}"].to_numpy()
        sizes = np.bincount(inner[inside])
        assert len(sizes) == training.INNER and np.ptp(sizes) <= 1 and np.ptp([table["y"][inside & (inner == j)].sum() for j in range(training.INNER)]) <= 1
        scores = []
        for depth, trees, rate in grid:
            own = []
            for j in range(training.INNER):
                train, test = inside & (inner != j), inside & (inner == j)
                forest = boosting.fit_forest(table[names].to_numpy()[train], table["y"].to_numpy(float)[train], depth, trees, rate)
                own.append(auc(table["y"].to_numpy()[test], 1 / (1 + np.exp(-boosting.margins(forest, table[names].to_numpy()[test])))))
            scores.append(np.mean(own))
        want[k] = grid[int(np.argmax(np.round(scores, 12)))]
    assert chosen[0][0] == want and chosen[0][1] == fitted.settings
