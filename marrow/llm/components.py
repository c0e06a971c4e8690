"""Connected components by alternating star joins, all state in written tables.

A node of very many links is dealt to parts: its smallest neighbour is found among those of its parts and
joined part by part, so no task holds all its links. Each round links every node's larger neighbours to its smallest one (large star), then every node's
smaller neighbours likewise (small star), until nothing changes; the number of rounds grows with the
logarithm of the longest chain. Only sums and minima leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm.shared import remove, salt, written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges with m, the smallest v of their u."""
    edges = edges.withColumn("part", salt("v"))
    least = edges.groupBy("u", "part").agg(F.min("v").alias("m")).withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return edges.join(least, ["u", "part"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    down = _with_least(edges).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame):
    # Sums of hashes wrap around, so they are taken over 62 bits as decimals.
    return edges.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 2).cast("decimal(20,0)"))).first()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node of edges (u, v) but the roots themselves.

    Loops and repeated edges are allowed; nulls are not. Node values are longs.
    """
    spark = edges.sparkSession
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars, before, i = written(both, f"{folder}/stars-0"), None, 0
    now = _state(stars)
    while now != before and now[0]:
        i += 1
        stars = written(_small_star(_large_star(stars)), f"{folder}/stars-{i}")
        remove(spark, f"{folder}/stars-{i - 1}")
        before, now = now, _state(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
