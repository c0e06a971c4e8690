"""Split-conformal thresholds and verdicts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import scalar

VERDICTS = ("positive", "negative", "uncertain")
#: Buckets that a range of nonconformities is counted by, and the rows that are ordered in one task at most.
BUCKETS = 1024
MOST_ORDERED = 100_000


def q_hat(scored: DataFrame, alpha: float = 0.1) -> DataFrame:
    """q_hat: the k-th smallest nonconformity of n, k = min(n, ceil((n + 1)(1 - alpha))); NULL without rows.

    While the range that holds rank k has too many rows to order, its rows are counted by bucket and the range shrinks to
    the least and largest value of the bucket that holds the rank. So scores may crowd anywhere; a round is one pass
    that returns a row a bucket. Rows with a missing label or score are left out; scores that aren't finite are refused.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie in (0, 1)")
    s = scored.where("y IS NOT NULL AND p IS NOT NULL").select(scalar.nonconformity(F.col("y"), F.col("p")).alias("s"))
    n, low, high = s.agg(F.count(F.lit(1)), F.min("s"), F.max("s")).first()
    if n and not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError("scores must be finite")
    k, before, held = min(n, math.ceil((n + 1) * (1 - alpha))), 0, n
    while held > MOST_ORDERED and low < high:
        # The least value lies in the first bucket and the largest in the last, so every round narrows the range.
        bucket = F.least(F.floor((F.col("s") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        counted = s.where(F.col("s").between(low, high)).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
        for row in sorted(counted.collect()):  # a row a bucket
            if before + row["n"] >= k:
                held, low, high = row["n"], row["low"], row["high"]
                break
            before += row["n"]
    values = s.where(F.col("s").between(low, high)).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("upto", upto + before).where(F.col("upto") >= k).agg(F.min("s").alias("q_hat"))


def verdicts(scored: DataFrame, q: float) -> DataFrame:
    return scored.withColumn("verdict", scalar.prediction_set(F.col("p"), q))


def verdict_fractions(judged: DataFrame) -> DataFrame:
    """verdict, fraction for every verdict, also those that don't occur."""
    row = judged.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.coalesce(F.try_divide(F.col(v), F.col("n")), F.lit(0.0)).alias("fraction")) for v in VERDICTS])).alias("x")).select("x.*")
