"""Folds, splits and encodings. Chance is a hash of the row's key, so it doesn't depend on partitioning.

Global ranks are taken in two steps, bucket offsets and ranks within a bucket, so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Boosting settings in their fixed order: depth, trees, learning rate.
GRID = tuple((d, n, r) for d in (2, 3, 4) for n in (100, 300) for r in (0.05, 0.1))


def chance(key: str, seed: int) -> Column:
    """A number in [0, 2147483647) for a long key, from integer arithmetic that any SQL engine repeats."""
    x = F.pmod(F.pmod(F.col(key).cast("long"), F.lit(2147483647)) * 1000003 + F.lit(seed * 7919 + 12345), F.lit(2147483647))
    return F.pmod(F.pmod(x * x, F.lit(2147483647)) * 48271, F.lit(2147483647))


def ranked(df: DataFrame, classes: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Adds the zero-based rank within a class, by bucket and then by order; bucket must not fall as order rises."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*classes, "_b").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*classes).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_{c}") for c in classes], F.col("_b").alias("_at"), F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    same = F.col("_b") == F.col("_at")
    for c in classes:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inner = df.withColumn("_r", F.row_number().over(Window.partitionBy(*classes, "_b").orderBy(*order)))
    return inner.join(offsets, same).withColumn(name, F.col("_before") + F.col("_r") - 1).drop("_b", "_at", "_before", "_r", *[f"_{c}" for c in classes])


def _dealt(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds _rank within the label's class, in chance order."""
    df = df.withColumn("_c", chance(key, seed))
    return ranked(df, [label], ["_c", key], F.floor(F.col("_c") * F.lit(BUCKETS / 2147483647.0)), "_rank").drop("_c")


def stratified_folds(df: DataFrame, k: int, label: str = "y", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds fold: rows dealt in turn, class after class, so folds' sizes and their classes' sizes differ by one at most."""
    dealt = _dealt(df, label, key, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # a row a class
    before = F.coalesce(F.sum("_n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(label).alias("_y"), before.alias("_start"))
    return dealt.join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("_y"))).withColumn("fold", F.pmod(F.col("_start") + F.col("_rank"), F.lit(k)).cast("int")).drop("_rank", "_y", "_start")


def stratified_split(df: DataFrame, share: float = 0.3, label: str = "y", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds part: "calibration" for a class's first rows in chance order, their share rounded, else "evaluation"."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(label, "_y")
    joined = _dealt(df, label, key, seed).join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("_y")))
    return joined.withColumn("part", F.when(F.col("_rank") < F.floor(F.col("_n") * F.lit(share) + 0.5), "calibration").otherwise("evaluation")).drop("_rank", "_y", "_n")


def stratified_subsample(df: DataFrame, most: int, label: str = "y", key: str = "row_id", seed: int = 42) -> DataFrame:
    """At most this many rows, classes in proportion, exactly as many as asked; df itself if it has no more."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    total = sum(sizes.values())
    if total <= most:
        return df
    quota = {y: n * most // total for y, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda y: (-(sizes[y] * most % total), str(y)))
    for y in by_rest[: most - sum(quota.values())]:
        quota[y] += 1
    limit = F.lit(0)
    for y, q in quota.items():
        limit = F.when(F.col(label).eqNullSafe(F.lit(y)), q).otherwise(limit)
    return _dealt(df, label, key, seed).where(F.col("_rank") < limit).drop("_rank")


def categories(train: DataFrame, column: str) -> list:
    """Distinct values seen in training, in order; a category list is meant to be short."""
    return [r[0] for r in train.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    """A 0/1 column for each value, in place of column; missing and unseen values are zero in all."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}).drop(column)


def reindexed(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly these columns in this order; absent ones are 0."""
    return df.select(*keep, *[F.col(f"`{c}`") if c in df.columns else F.lit(0).alias(c) for c in columns])


def best_combination(scores: DataFrame) -> DataFrame:
    """fold, combo: the largest mean score, of equal ones the first in grid order. scores: fold, combo, score."""
    means = scores.groupBy("fold", "combo").agg(F.avg("score").alias("score"))
    return means.withColumn("r", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("score"), "combo"))).where("r = 1").select("fold", "combo", "score")


def modal_combination(chosen: DataFrame) -> DataFrame:
    """combo, n: chosen in most folds, of equal ones the one chosen first."""
    counts = chosen.groupBy("combo").agg(F.count(F.lit(1)).alias("n"), F.min("fold").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), F.col("first"), F.col("combo"))).alias("b")
    return counts.agg(best).select(F.col("b.combo").alias("combo"), (-F.col("b.minus")).alias("n"))


def sampled_in_order(df: DataFrame, most: int, key: str = "row_id", seed: int = 0) -> DataFrame:
    """A sample of at most this many rows, back in the order of key."""
    return df.withColumn("_c", chance(key, seed)).orderBy("_c", key).limit(most).drop("_c").orderBy(key)
