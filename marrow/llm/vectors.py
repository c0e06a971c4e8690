"""Blocks of vectors, and the joining of query blocks with candidate blocks.

A table of vectors becomes rows that each hold a block: up to ``block`` ids and a matrix, as bytes, of about
BLOCK_BYTES at most. Blocks of candidates and of queries are dealt to groups, and every pair of groups is one
piece of work with a key of its own. There are about PARTS pieces however many blocks there are. A task holds the
query blocks of its group, at most QUERY_GROUP, and lets the candidate blocks stream past them; for each query it keeps
the k best so far, and the search may drop what cannot reach the k-th of them. A window then keeps the k best of all groups.

So the shuffle carries packed blocks instead of pairs of vectors. A candidate block is sent once for every
group of query blocks, a query block once for every group of candidates; the groups' numbers are chosen so that both
sides send about as much, and the query groups' number grows beyond that only to bound a task's memory.

Defined cases, for both searches: vectors that are null, empty or hold null or non-finite components take
no part, neither do rows with a null vec_id; rows alike in vec_id and vector count once; different
vectors under one vec_id are candidates of their own, for all queries but the one with that id, which is asked
once (with the smallest of them in array order); vectors of different dimensions never meet; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8_192
QUERY_BLOCK = 8_192
#: Of a block's matrix, whatever the dimension; 8,192 vectors of 64 doubles.
BLOCK_BYTES = 1 << 22
#: Pairs of groups, at most about so many.
PARTS = 4_096
#: Query blocks that a task holds.
QUERY_GROUP = 16
BLOCK_FIELDS = "dim int, block long, ids binary, matrix binary, extra binary"


@dataclass(frozen=True)
class Block:
    """ids ascend; extra is what an operator's indexing adds to a block."""

    ids: np.ndarray
    matrix: np.ndarray
    extra: bytes


Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (queries, candidates, least) -> query ids, candidate ids, scores of each query's best in this block. Scores below a query's least don't count.
BlockSearch = Callable[[Block, Block, np.ndarray], Found]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nonzero: bool = False) -> DataFrame:
    """vec_id long, vector array<double>: the rows with a usable vector."""
    v = F.col("vector")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = out.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))
    if nonzero:
        out = out.where(F.exists(v, lambda x: x != 0))
    return out


def asked(rows: DataFrame, every: int) -> DataFrame:
    """Those whose vec_id is divisible by every, one row an id."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def pieces(vectors: DataFrame, block: int) -> int:
    """The number of blocks that hold ``block`` vectors or BLOCK_BYTES at most, on average."""
    rows, components = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    return max(1, -(-rows // block), -(-8 * components // BLOCK_BYTES))


def groups(held: int, q_held: int, parts: int = PARTS) -> tuple[int, int]:
    """How many groups candidate blocks and query blocks are dealt to."""
    if held * q_held <= parts:
        return held, q_held
    balanced = round((parts * q_held / held) ** 0.5)
    q_groups = min(q_held, max(1, balanced, -(-q_held // QUERY_GROUP)))
    return max(1, min(held, parts // q_groups)), q_groups


def blocks(vectors: DataFrame, number_of_blocks: int, index: Callable[[np.ndarray], tuple[np.ndarray, bytes]]) -> DataFrame:
    """vectors packed into so many blocks for each dimension, sorted by id.

    index: makes of a block's matrix the matrix to keep and the block's extra bytes.
    """
    # Dealt by id and vector, so that rows that share an id spread as well.
    number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number_of_blocks))
    keyed = vectors.select(F.size("vector").alias("dim"), number.alias("block"), "vec_id", "vector")

    def packed(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        dim = table["dim"][0].as_py()
        matrix = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):  # rows alike in id and vector lie in one block
            alike = np.concatenate([ids.reshape(-1, 1).view("<f8"), matrix], axis=1).view(np.dtype((np.void, 8 * (dim + 1)))).ravel()
            order = order[np.isin(order, np.unique(alike, return_index=True)[1])]
        kept, extra = index(matrix[order])
        row = [dim, table["block"][0].as_py(), ids[order].tobytes(), kept.tobytes(), extra]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in BLOCK_FIELDS.split(", ")])

    return keyed.groupBy("dim", "block").applyInArrow(packed, BLOCK_FIELDS)


def merged(found: list[Found], k: int) -> Found:
    """Each query's k best, by score and then by smaller id; ordered by query."""
    query, ids, scores = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], ids[rank < k], scores[rank < k]


def kth_best(best: Found, queries: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query, minus infinity where fewer are known. queries ascend."""
    starts, ends = np.searchsorted(best[0], queries), np.searchsorted(best[0], queries, "right")
    least = np.full(len(queries), -np.inf)
    full = ends - starts >= k
    least[full] = best[2][starts[full] + k - 1]
    return least


def best_of_blocks(candidates: DataFrame, queries: DataFrame, search: BlockSearch, k: int, score_type: str, counts: tuple[int, int]) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best, by score and then by smaller id. counts: numbers that blocks of candidates and of queries have."""
    c_groups, q_groups = groups(*counts)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod("block", F.lit(n).cast("long"))
    held = ["dim", "ids", "matrix", "extra"]
    q = queries.select(*held, every(c_groups).alias("c_group"), own(q_groups).alias("q_group"), F.lit(0).alias("side"))
    c = candidates.select(*held, own(c_groups).alias("c_group"), every(q_groups).alias("q_group"), F.lit(1).alias("side"))
    keys = ["dim", "c_group", "q_group"]
    met = q.unionByName(c).repartition(c_groups * q_groups, *keys).sortWithinPartitions(*keys, "side")  # queries first
    kind, number = (pa.int64(), np.int64) if score_type == "long" else (pa.float64(), np.float64)
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked_blocks, best = None, [], []

        def rows() -> Iterator[pa.RecordBatch]:
            for query, ids, scores in best:
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                dim, side, *key = (batch.column(c)[row].as_py() for c in ("dim", "side", "c_group", "q_group"))
                if (dim, *key) != at:
                    yield from rows()
                    at, asked_blocks, best = (dim, *key), [], []
                if side and not asked_blocks:
                    continue  # no query has this dimension
                ids, matrix, extra = (batch.column(c)[row].as_py() for c in ("ids", "matrix", "extra"))
                block = Block(np.frombuffer(ids, "<i8"), np.frombuffer(matrix, "<f8").reshape(-1, dim), extra)
                if not side:
                    asked_blocks.append(block)
                    best.append(nothing)
                    continue
                for i, wanted in enumerate(asked_blocks):
                    best[i] = merged([best[i], search(wanted, block, kth_best(best[i], wanted.ids, k))], k)
        yield from rows()

    found = met.mapInArrow(searched, f"query_id long, vec_id long, score {score_type}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of_row(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, by score and then by position; positions follow the ids' order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))][:k]
