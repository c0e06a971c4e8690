"""Exact top-k: a chunk's survivors are scored by one product of matrices; integers beyond doubles still one by one."""

import numpy as np
import pytest

from marrow.llm import topk
from marrow.llm.vectors import Block, kth_best, merged

UNKNOWN = -np.inf


def block(ids, rows, scale=1.0):
    whole, extra = topk.statistics(np.array(rows, float), scale)
    return Block(np.array(ids, np.int64), whole, extra)


def brute(queries, rows, k):
    """queries, rows: (id, integers) in the order of ids."""
    out = []
    for q, a in queries:
        best = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), i, n) for n, (i, b) in enumerate(rows) if i != q)[:k]
        out += [(q, i, -s) for s, i, _ in best]
    return out


def listed(found):
    return list(zip(*(x.tolist() for x in found)))


def data(n, dim, seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "walks":
        return np.floor(np.cumsum(rng.normal(size=(n, dim)), axis=1) * 64)
    if kind == "ties":
        return rng.integers(-1, 2, (n, dim)).astype(float)
    return np.floor(rng.normal(size=(n, dim)) * 256)


@pytest.mark.parametrize("kind", ["walks", "ties", "noise"])
def test_blocks_against_brute_force_with_and_without_known_scores(kind):
    rows = data(900, 40, 2, kind)
    rows[7] = rows[8] = rows[9] = 0
    ids = np.repeat(np.arange(450), 2)  # two vectors an id
    pairs = list(zip(ids.tolist(), rows.tolist()))
    queries = [(q, pairs[2 * q][1]) for q in range(0, 450, 3)]
    q = block([i for i, _ in queries], [v for _, v in queries])
    parts = [block(ids[a:b], rows[a:b]) for a, b in ((0, 3), (3, 500), (500, 900))]
    best = (np.zeros(0, np.int64),) * 3
    for part in parts:
        best = merged([best, topk.search_block(q, part, 5, kth_best(best, q.ids, 5))], 5)
    assert listed(best) == brute(queries, pairs, 5)
    whole = merged([topk.search_block(q, block(ids, rows), 5, np.full(len(q.ids), UNKNOWN))], 5)
    assert listed(whole) == listed(best)


def test_known_scores_that_tie_stay():
    q, c = block([0], [[2, 0]]), block([1, 2, 3], [[5, 1], [4, 0], [5, 9]])
    assert listed(topk.search_block(q, c, 2, np.array([10.0]))) == [(0, 1, 10), (0, 3, 10)]
    assert listed(topk.search_block(q, c, 2, np.array([11.0]))) == []


def test_integers_beyond_doubles_are_exact_and_beyond_a_long_an_error():
    big = 2.0**28
    rows = [[big, 1, 1], [big, 1, 0], [big, 0, 0], [-big, 3, 3], [1, 1, 1]]
    q, c = block([0], [[big, 1, 1]]), block(range(5), rows)
    assert listed(topk.search_block(q, c, 4, np.array([UNKNOWN]))) == brute([(0, [big, 1, 1])], list(enumerate(rows)), 4)
    with pytest.raises(OverflowError):
        topk.search_block(block([9], [[2.0**40, 0, 0]]), block([1], [[2.0**40, 0, 0]]), 1, np.array([UNKNOWN]))


def test_empty_blocks():
    q, none = block([0, 50], [[1, 2], [3, 4]]), Block(np.zeros(0, np.int64), np.zeros((0, 2)), b"")
    assert listed(topk.search_block(q, none, 5, np.full(2, UNKNOWN))) == []
    assert listed(topk.search_block(none, q, 5, np.zeros(0))) == []


def test_survivors_of_a_chunk_are_scored_together(monkeypatch):
    asked, one = [], topk._exact
    monkeypatch.setattr(topk, "_exact", lambda q, x, *more: asked.append(len(x)) or one(q, x, *more))
    rows = data(2000, 64, 3, "noise")
    q, c = block(range(0, 2000, 20), rows[::20]), block(range(2000), rows)
    first = topk.search_block(q, c, 5, np.full(100, UNKNOWN))
    assert max(asked) <= 6 and len(asked) <= 2 * 100  # a few rows of best bounds, no survivors one query at a time
    del asked[:]
    again = topk.search_block(q, c, 5, kth_best(first, q.ids, 5))
    assert not asked and listed(again) == listed(first)
