"""Approximate nearest neighbours by a permutation index.

The index is fitted on a bounded sample: up to ``pivots`` vectors, those with the smallest hashed ids.
Every vector is represented by its ``listed`` nearest pivots in order of nearness (cosine). A block of
vectors posts them in an inverted file: for each pivot the rows that list it, with its position in their
lists. A query's own list is looked up in the inverted files; Spearman's footrule between the two lists,
a missing pivot standing at position ``listed``, follows from the shared pivots' positions alone. The
``share`` of each block with the smallest footrule is reranked by exact inner products in doubles.

The share is the same at every size, so recall doesn't fall as tables grow. A dimension with fewer pivots
than are listed is searched whole, since its lists tell rows apart badly or not at all. Zero vectors take no part;
for other defined cases see vectors.py.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.shared import work_dir, written
from marrow.llm.vectors import BLOCK, QUERY_BLOCK, Block, Found, asked, best_of_blocks, blocks, pieces, top_of_row, usable

PIVOTS = 256
LISTED = 32
SHARE = 0.45


def nearest_pivots(matrix: np.ndarray, pivots: np.ndarray, listed: int) -> np.ndarray:
    """For each row the numbers of its nearest pivots, nearest first; ties go to the smaller number."""
    units = pivots / np.sqrt((pivots**2).sum(axis=1, keepdims=True))
    return np.argsort(-(matrix @ units.T), axis=1, kind="stable")[:, :listed].astype(np.int32)


def inverted_file(lists: np.ndarray, pivots: int) -> bytes:
    """Where each pivot's posts begin, the posts' rows, and their positions, all int32."""
    rows, listed = lists.shape
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(pivots + 1))
    return np.concatenate([starts, order // max(1, listed), order % max(1, listed)]).astype("<i4").tobytes()


class Posts:
    def __init__(self, content: bytes, pivots: int):
        numbers = np.frombuffer(content, "<i4")
        posts = (len(numbers) - pivots - 1) // 2
        self.starts, self.rows, self.positions = numbers[: pivots + 1], numbers[pivots + 1 : pivots + 1 + posts], numbers[pivots + 1 + posts :]

    def footrule(self, query: np.ndarray, rows: int) -> np.ndarray:
        """The footrule of every row's list, less what all rows have alike."""
        listed, at, gain = len(query), [], []
        for position, pivot in enumerate(query):
            part = slice(self.starts[pivot], self.starts[pivot + 1])
            theirs = self.positions[part]
            at.append(self.rows[part])
            gain.append(np.abs(theirs - position) - (listed - position) - (listed - theirs))
        return np.bincount(np.concatenate(at), weights=np.concatenate(gain), minlength=rows)


def search_block(queries: Block, candidates: Block, pivots: int, listed: int, k: int, share: float) -> Found:
    rows = len(candidates.ids)
    posts, lists = Posts(candidates.extra, pivots), np.frombuffer(queries.extra, "<i4").reshape(-1, listed)
    taken, found = max(4 * k, int(np.ceil(share * rows))), []
    for i, query in enumerate(queries.ids):
        near = np.arange(rows)
        if taken < rows:
            near = np.sort(np.argpartition(posts.footrule(lists[i], rows), taken)[:taken])
        near = near[candidates.ids[near] != query]
        scores = candidates.matrix[near] @ queries.matrix[i]
        best = top_of_row(scores, k)
        found.append((np.full(len(best), query), candidates.ids[near[best]], scores[best]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(vectors: DataFrame, every: int, k: int, pivots: int = PIVOTS, listed: int = LISTED, share: float = SHARE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by every, the k nearest other rows found."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "permutation")
    rows = written(usable(vectors, nonzero=True), f"{folder}/vectors")
    wanted = written(asked(rows, every), f"{folder}/asked")
    if wanted.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()  # at most ``pivots`` rows
    chosen: dict[int, np.ndarray] = {}
    for r in sample:
        chosen.setdefault(len(r["vector"]), []).append(r["vector"])
    chosen = {dim: np.array(v) for dim, v in chosen.items()}
    told_apart = {dim for dim, v in chosen.items() if len(v) >= listed}

    def lists(matrix: np.ndarray) -> tuple[np.ndarray, int]:
        own = chosen.get(matrix.shape[1], matrix[:1])
        held = np.concatenate([own, np.repeat(own[:1], max(0, listed - len(own)), axis=0)])
        return nearest_pivots(matrix, held, listed), max(pivots, listed)

    def indexed(matrix: np.ndarray) -> tuple[np.ndarray, bytes]:
        found, width = lists(matrix)
        return matrix, inverted_file(found, width)

    counts = pieces(rows, block), pieces(wanted, query_block)
    held = written(blocks(rows, counts[0], indexed), f"{folder}/blocks")
    met = written(blocks(wanted, counts[1], lambda m: (m, lists(m)[0].tobytes())), f"{folder}/queries")

    def search(queries: Block, candidates: Block, known: np.ndarray) -> Found:
        part = share if queries.matrix.shape[1] in told_apart else 1.0
        return search_block(queries, candidates, max(pivots, listed), listed, k, part)

    return best_of_blocks(held, met, search, k, "double", counts)
