"""Every fit of the training runs once, as a task of its own, and none on the driver."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext

from marrow.operators import boosting
from marrow.plans import train as training


def test_every_fit_runs_once_and_in_a_task(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(300), "y": (x[:, 0] + rng.normal(size=300) > 0).astype(int), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    asked, real, one = [], boosting.fit_many, boosting.fit_forest

    def counted(spark, table, features, specs, *rest):
        folder = tmp_path / str(len(asked))
        folder.mkdir()
        asked.append(len(specs))
        fits = real(spark, table, features, specs, *rest)

        def marked(batches):
            seen = set()
            for batch in batches:
                for spec in set(batch["spec"]) - seen:
                    (folder / f"{spec} {uuid.uuid4().hex}").touch()
                    seen.add(spec)
                yield batch

        return fits.mapInPandas(marked, fits.schema)

    def in_task(*args, **named):
        assert TaskContext.get(), "a fit on the driver"
        return one(*args, **named)

    want = boosting.fit_forest(x.astype(np.float32), df.toPandas()["y"].to_numpy(), 2, 3, 0.3, ("a", "b", "c"))
    monkeypatch.setattr(boosting, "fit_many", counted)
    monkeypatch.setattr(boosting, "fit_forest", in_task)
    fitted = training.train(df, ["a", "b", "c"], grid=((1, 1, 0.1), (2, 3, 0.3)))
    assert fitted.oof.count() == 300
    assert asked == [training.OUTER * 2 * training.INNER, training.OUTER + 1]
    assert [len(list((tmp_path / str(i)).iterdir())) for i in range(2)] == asked
    if fitted.settings == (2, 3, 0.3):
        assert fitted.forest == want


def test_sums_of_a_child_are_exact():
    """Equal gains are told apart by place, not by rounding: missing values that aren't there go left."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, size=(3000, 6)).astype(np.float32)
    x[rng.random(x.shape) < 0.2] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=30) > 20).astype(int) ^ (rng.random(3000) < 0.1)
    forest = boosting.fit_forest(x, y, 3, 20, 0.2)
    order = rng.permutation(3000)
    assert boosting.fit_forest(x[order], y[order], 3, 20, 0.2) == forest
    for tree in forest.trees:
        todo = [(0, np.arange(3000))]
        while todo:
            at, rows = todo.pop()
            f, t, l, r, m, _ = tree[at]
            if f >= 0:
                value = x[rows, f]
                if not np.isnan(value).any():
                    assert m == l
                left = np.where(np.isnan(value), m == l, value < np.float32(t))
                todo += [(l, rows[left]), (r, rows[~left])]
    assert boosting.margins(forest, x[:1]) == pytest.approx(boosting.walk(forest, x[0].tolist()))
