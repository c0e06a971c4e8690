"""Exact top-k search by multi-resolution segment statistics.

A vector is cut into 1, 4, 16 and 32 segments. With a segment's mean m and deviation s (the root of the summed
squared differences from the mean), Cauchy-Schwarz bounds a segment's part of an inner product by
length * m * m' + s * s'. Summed over the segments this is an upper bound on the inner product, so a lower
bound on the distance that it stands for, and it grows tighter from level to level. A block's candidates
pass the levels from coarse to fine; those whose bound stays below the k-th best exact score known so far, of this block or of those before it in the task,
are dropped, and the survivors' scores are computed exactly. Ties at the k-th score always survive. While doubles hold
all sums of a pair of blocks, the survivors of a chunk of queries are scored by one product of matrices.

Components are floor(scale * x); sums are exact: in doubles while they stay below 2^53, else in Python's
integers. A score beyond a long is an error. Other defined cases: see vectors.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from marrow.llm.shared import work_dir, written
from marrow.llm.vectors import BLOCK, QUERY_BLOCK, Block, Found, asked, best_of_blocks, blocks, pieces, top_of_row, usable

LEVELS = (1, 4, 16, 32)
#: Levels whose best bounds are scored, for queries of which no score is known. Others gain less than that costs, while one product scores all survivors.
SCORED_LEVELS = (1, 16)
#: Queries whose bounds are held at once.
CHUNK = 128


def segment_features(matrix: np.ndarray, segments: int) -> np.ndarray:
    """A row for each vector whose inner product with another's is the bound at this level."""
    edges = np.linspace(0, matrix.shape[1], min(segments, matrix.shape[1]) + 1).astype(int)
    parts = [matrix[:, a:b] for a, b in zip(edges, edges[1:])]
    means = np.stack([p.mean(axis=1) * np.sqrt(p.shape[1]) for p in parts], axis=1)
    deviations = np.stack([np.sqrt(((p - p.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)) for p in parts], axis=1)
    return np.concatenate([means, deviations], axis=1)


def statistics(matrix: np.ndarray, scale: float) -> tuple[np.ndarray, bytes]:
    """The integer components as doubles, and the features of all levels."""
    whole = np.floor(scale * matrix)
    return whole, b"".join(segment_features(whole, s).astype("<f8").tobytes() for s in LEVELS)


def _features(block: Block) -> list[np.ndarray]:
    out, at, (rows, dim) = [], 0, block.matrix.shape
    for s in LEVELS:
        width = 2 * min(s, dim)
        out.append(np.frombuffer(block.extra, "<f8", rows * width, at).reshape(rows, width))
        at += 8 * rows * width
    return out


def _held(queries: np.ndarray, candidates: np.ndarray) -> bool:
    """Whether doubles hold all sums of inner products of these integers exactly."""
    largest = [max(m.max(initial=0), -m.min(initial=0)) for m in (queries, candidates)]
    return largest[0] * largest[1] * queries.shape[1] < 2**53


def _exact(q: np.ndarray, x: np.ndarray, held: bool) -> np.ndarray:
    """Inner products of one query with rows of integers, as int64. held: see _held()."""
    if not held and not _held(q[None], x):
        whole = [int(a) for a in q]
        sums = [sum(a * int(b) for a, b in zip(whole, row)) for row in x]
        return np.array(sums, dtype=np.int64)  # raises OverflowError beyond a long
    return (x @ q).astype(np.int64)


def _products(q: np.ndarray, x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with the rows of x at places, which ascend."""
    return q @ (x if len(places) == len(x) else x[places]).T


def search_block(queries: Block, candidates: Block, k: int, known: np.ndarray) -> Found:
    """Each query's k best candidates with another id; those below the score known of a query may be left out."""
    q_levels, c_levels = _features(queries), _features(candidates)
    norm = np.sqrt((candidates.matrix**2).sum(axis=1)).max(initial=0)
    held = _held(queries.matrix, candidates.matrix)
    found: list[Found] = []
    for at in range(0, len(queries.ids), CHUNK):
        part = slice(at, at + CHUNK)
        ids, matrix = queries.ids[part], queries.matrix[part]
        slack = 1e-9 * (1 + np.sqrt((matrix**2).sum(axis=1)) * norm)
        alive = ids[:, None] != candidates.ids[None, :]
        least, places = known[part].copy(), np.arange(len(candidates.ids))
        # The blocks before this one tell more than a few of its own rows would.
        unknown = np.flatnonzero(least == -np.inf).tolist()
        for segments, q_features, c_features in zip(LEVELS, q_levels, c_levels):
            columns = np.flatnonzero(alive.any(axis=0))
            if len(columns) < alive.shape[1]:  # the others are dropped by all queries of the chunk
                alive, places = alive[:, columns], places[columns]
            below = _products(-q_features[part], c_features, places)  # the bounds' negatives, so that the best come first
            np.putmask(below, ~alive, np.inf)
            for i in range(len(ids)) if not held else unknown if segments in SCORED_LEVELS else ():  # the best bounds are likely good scores
                likely = np.argpartition(below[i], k)[: k + 1] if below.shape[1] > k + 1 else np.arange(below.shape[1])
                likely = likely[alive[i, likely]]
                if len(likely) >= k:
                    least[i] = max(least[i], np.sort(_exact(matrix[i], candidates.matrix[places[likely]], held))[-k])
            alive &= below <= (slack - least)[:, None]
            del below  # so that the next product takes its place
        if held:
            together = _products(matrix, candidates.matrix, places)
            alive &= together >= least[:, None]
        for i, query in enumerate(ids):
            rows = np.flatnonzero(alive[i])
            scores = together[i, rows].astype(np.int64) if held else _exact(matrix[i], candidates.matrix[places[rows]], held)
            best = top_of_row(scores, k)
            found.append((np.full(len(best), query), candidates.ids[places[rows[best]]], scores[best]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def top_k(vectors: DataFrame, every: int, k: int, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by every, the k other rows of largest score."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "topk")
    rows = written(usable(vectors), f"{folder}/vectors")
    wanted = written(asked(rows, every), f"{folder}/asked")
    index = lambda m: statistics(m, scale)
    counts = pieces(rows, block), pieces(wanted, query_block)
    held = written(blocks(rows, counts[0], index), f"{folder}/blocks")
    met = written(blocks(wanted, counts[1], index), f"{folder}/queries")
    return best_of_blocks(held, met, lambda q, c, known: search_block(q, c, k, known), k, "long", counts)
