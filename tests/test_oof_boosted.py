"""oof_boosted trains on every feature over the reference's whole grid of settings."""

import inspect

import pytest

from marrow.operators import resample
from marrow.plans import queries
from marrow.plans import train as training


def test_whole_grid_and_all_features(spark, monkeypatch):
    asked, real = {}, inspect.signature(training.train)

    def seen(*args, **named):
        bound = real.bind(*args, **named)
        bound.apply_defaults()
        asked.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(training, "train", seen)
    with pytest.raises(InterruptedError):
        queries.oof_boosted(spark, "/root/testdata/sf0.001")
    assert asked["grid"] == resample.GRID and len(resample.GRID) == 12
    assert asked["features"] == [f"x{i}" for i in range(64)]
    assert asked["df"].columns == ["row_id", "y", *asked["features"]]
