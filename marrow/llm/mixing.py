"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's words, its documents laid end to end in a fixed order, are cut into blocks of equally many words.
Targets are weights' shares of a budget, held to MOST_PASSES times a source's size; what exceeds that goes to the others by
weight. Seats, one for each block that the mix takes, go to the sources by highest quotients target / (2k + 1). The sequence
of quotients is cut into equal runs, one for each shard, so every shard has an integer quota of every source, and the
first shards alone are an apportionment too. A source's seats then select its blocks in a seeded order (an affine
permutation of their numbers, so nothing is sorted or listed); seats beyond the last block start a second pass.

Only (document, source, size) rows are shuffled, never texts. A source's running word counts come from buckets of rows, so
the largest source spreads like any other. The driver holds a row a source: sources are what weights are given for.

Defined cases: a null text has no words, a null source is a source of its own, last in order; sources without words have target 0
and their excess is shared among the others; when all are full every document is taken MOST_PASSES times; rows that repeat a doc_id
are documents of their own; an empty table gives an empty result; other columns are ignored. The order of blocks is fixed by a hash
of doc_id and size, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm.shared import work_dir, written

WEIGHTS, SHARE, MOST_PASSES, SHARDS = (5, 2, 1), 1.5, 2, 16
#: Words of a block: so many, or fewer where the smallest source would have fewer than LEAST_BLOCKS.
BLOCK_WORDS, LEAST_BLOCKS = 64, 256
#: Rows of one source and bucket on average, at most.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256
#: Blocks of a source; the permutation's products then fit 64 bits.
MOST_BLOCKS = 1 << 40


@dataclass(frozen=True)
class Source:
    key: str
    size: int
    target: float
    blocks: int
    #: Seats up to the end of each shard.
    seats: tuple[int, ...]
    #: The rank of block b is (factor * b + shift) mod blocks.
    factor: int
    shift: int


def targets(sizes: list[int], weights: list[float], budget: float, most_passes: float = MOST_PASSES) -> list[float]:
    """Shares of budget by weight, none above most_passes times its size; the excess is shared again until none is above."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), budget
    while free:
        total = math.fsum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total >= most_passes * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most_passes * sizes[i])
        left -= math.fsum(out[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return out


def apportion(targets: list[float], limits: list[int], seats: int) -> list[int]:
    """Sainte-Lague: seats by highest quotients target / (2k + 1), ties to the earlier source; none gets more than its limit.

    A divisor found by bisection gives all but a few seats for each source, the last ones are dealt from a heap.
    """
    t, most = np.array(targets, float), np.array(limits, np.int64)
    seats = min(seats, int(most[t > 0].sum()))
    won = lambda d: np.minimum(most, np.floor(t / d + 0.5)).astype(np.int64)
    low, high = 0.0, max(4 * t.max(initial=0.0), 1e-300)  # won(high) is nothing
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or mid <= 1e-290:
            break
        low, high = (mid, high) if won(mid).sum() > seats else (low, mid)
    given = np.maximum(0, won(high) - 2).tolist() if len(t) else []
    quotients = [(-t[i] / (2 * k + 1), i) for i, k in enumerate(given) if t[i] > 0 and k < most[i]]
    heapq.heapify(quotients)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(quotients)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(quotients, (-t[i] / (2 * given[i] + 1), i))
    return given


def _order_of(key: str, blocks: int, seed: int) -> tuple[int, int]:
    """factor and shift of the seeded permutation."""
    drawn = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).digest()
    factor, shift = (int.from_bytes(drawn[i : i + 8], "big") % max(blocks, 1) for i in (0, 8))
    while math.gcd(factor, blocks) != 1:
        factor += 1
    return factor, shift


def plan(sizes: dict[str, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_passes: int = MOST_PASSES, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 0) -> tuple[int, list[Source]]:
    """Words of a block, and each source's target, quotas and order. sizes: words by key, weights repeat in order of the keys."""
    keys = sorted(sizes)
    size = [sizes[k] for k in keys]
    wanted = targets(size, [weights[i % len(weights)] for i in range(len(keys))], share * sum(size), most_passes)
    words = max(1, min([block_words, *(n // LEAST_BLOCKS for n in size if n)]))
    blocks = [-(-n // words) for n in size]
    if max(blocks, default=0) >= MOST_BLOCKS:
        raise ValueError(f"a source has {max(blocks)} blocks; make them larger")
    total = round(math.fsum(wanted) / words)
    by_shard = [apportion(wanted, [most_passes * n for n in blocks], total * (j + 1) // shards) for j in range(shards)]
    return words, [Source(k, size[i], wanted[i], blocks[i], tuple(q[i] for q in by_shard), *_order_of(k, blocks[i], seed)) for i, k in enumerate(keys)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _rank(block: Column) -> Column:
    """(factor * block + shift) mod blocks without overflow: the factor is taken in two halves of 20 bits."""
    n, half = F.col("blocks"), 1 << 20
    high = F.pmod(F.pmod(F.floor(F.col("factor") / half).cast("long") * block, n) * half, n)
    return F.pmod(high + F.pmod(F.col("factor") % half * block, n) + F.col("shift"), n)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and what pieces() needs. settings: see plan()."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "mixing")
    key = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), word_count(F.col(text_col)).alias("size")), f"{folder}/sizes")
    buckets = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.lit(buckets)))
    sums = written(rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")), f"{folder}/sums")
    words, sources = plan({r["key"]: r["n"] for r in sums.groupBy("key").agg(F.sum("n").alias("n")).collect()}, seed=seed, **settings)
    fields = "key string, source_size long, target double, blocks long, seats array<long>, factor long, shift long"
    quotas = spark.createDataFrame([(s.key, s.size, s.target, s.blocks, list(s.seats), s.factor, s.shift) for s in sources], fields)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(quotas, "key")
    within = Window.partitionBy("key", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["key", "bucket"])
    placed = placed.withColumn("start", F.col("offset") + F.col("inner")).withColumn("block_words", F.lit(words).cast("long"))
    seats = F.element_at("seats", -1)
    # Seats of a block: its rank, and again every ``blocks`` seats.
    passes = lambda b: F.ceil(F.greatest(seats - _rank(b), F.lit(0)) / F.col("blocks"))
    taken = F.aggregate(_blocks_of(), F.lit(0).cast("long"), lambda total, b: total + _overlap(b) * passes(b))
    return placed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0))).select("doc_id", F.expr("IF(key = '2', NULL, substr(key, 2))").alias("source"), "size", "source_size", "target", "taken", "start", "block_words", "blocks", "seats", "factor", "shift")


def _blocks_of() -> Column:
    """Numbers of the blocks that a document's words lie in."""
    first = F.floor(F.col("start") / F.col("block_words"))
    last = F.floor((F.col("start") + F.greatest(F.col("size"), F.lit(1)) - 1) / F.col("block_words"))
    return F.sequence(first, last)


def _overlap(block: Column) -> Column:
    """Words of the document in a block."""
    begin = block * F.col("block_words")
    return F.least(F.col("start") + F.col("size"), begin + F.col("block_words")) - F.greatest(F.col("start"), begin)


def pieces(mixed: DataFrame) -> DataFrame:
    """The mix itself: doc_id, source, seat, shard, first_word, words for every piece of a document in a block that the mix takes; repeats are rows of their own."""
    rows = mixed.where("size > 0").withColumn("block", F.explode(_blocks_of())).withColumn("rank", _rank(F.col("block")))
    rows = rows.where(F.col("rank") < F.element_at("seats", -1))
    rows = rows.withColumn("seat", F.explode(F.sequence(F.col("rank"), F.element_at("seats", -1) - 1, F.col("blocks"))))
    shard = F.size(F.filter("seats", lambda upto: upto <= F.col("seat")))
    first = F.greatest(F.col("block") * F.col("block_words"), F.col("start")) - F.col("start")
    return rows.select("doc_id", "source", "seat", shard.alias("shard"), first.alias("first_word"), _overlap(F.col("block")).alias("words"))
