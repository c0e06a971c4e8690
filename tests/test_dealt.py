"""Rows dealt to buckets by halves: parts agree with each other, and follow the multinomial distribution."""

import time

import numpy as np
import pytest

from marrow.operators.metrics import _dealt


def test_parts_add_up_and_have_the_right_moments():
    counts = np.array([5, 0, 40, 1, 30, 24, 100])
    before = np.concatenate([[0], counts.cumsum()])
    parts = [_dealt(before, b, 4000, (1, 0, 0)) for b in range(len(counts))]
    own = np.array([p[0] for p in parts])
    assert (own.sum(axis=0) == counts.sum()).all() and (own[1] == 0).all()
    for b, (_, above) in enumerate(parts):
        assert (above == own[b + 1 :].sum(axis=0)).all()
    p = counts / counts.sum()
    assert own.mean(axis=1) == pytest.approx(counts, abs=0.5)
    assert np.cov(own) == pytest.approx(counts.sum() * (np.diag(p) - np.outer(p, p)), abs=3.5)
    assert [x.tolist() for x in _dealt(before, 3, 4000, (1, 0, 0))] == [x.tolist() for x in parts[3]]


def test_work_grows_with_the_path_only():
    before = np.arange(5001) * 10
    began = time.perf_counter()
    for b in range(0, 5000, 100):
        own, above = _dealt(before, b, 2000, (0, 0, 1))
        assert own.shape == above.shape == (2000,)
    assert time.perf_counter() - began < 10


def test_empty_classes():
    own, above = _dealt(np.zeros(4, int), 1, 5, (0, 0, 0))
    assert own.tolist() == above.tolist() == [0] * 5
