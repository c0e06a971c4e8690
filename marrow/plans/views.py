"""Derived tables on which the queries run; each is also given as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / F.lit(20000.0)).alias("p"), F.col("lang").alias("grp"))
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id").select(F.col("doc_id").alias("row_id"), "y", "p", "grp")


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.pmod(k * 7919, F.lit(10007)) / F.lit(10007.0)).alias("p"), F.col("o_orderpriority").alias("site"))


def sentinel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    chol = F.when(F.col("event_type").isin("error", "signup") & (i % 4 == 0), 0.0).otherwise(150 + F.col("value") / 10)
    bps = F.when(i % 500 == 0, 0.0).otherwise((110 + i % 40).cast("double"))
    return read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("site"), chol.alias("chol"), bps.alias("trestbps"), (i % 2).cast("double").alias("flag"))


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.when(F.col("c_custkey") % 50 == 0, "ckd\t").when(F.col("c_acctbal") > 0, " ckd").otherwise("notckd")
    num = F.when(F.col("c_custkey") % 7 == 0, "?").when(F.col("c_custkey") % 11 == 0, "12d").otherwise(F.col("c_nationkey").cast("string"))
    return read(spark, sf_dir, "customer").select("c_custkey", cls.alias("cls"), num.alias("num"))


def cat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("row_id"), F.pmod(k, F.lit(5)).cast("int").alias("fold"), F.when(k % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("prio"), F.when(k % 3 == 0, None).otherwise(F.col("o_totalprice")).alias("price"))


def emb_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), (F.col("label") < 3).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(64)])


SD = "sd AS (SELECT l.doc_id AS row_id, l.quality AS y, least(1e0, d.n_chars / 20000e0) AS p, d.lang AS grp FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
SO = "so AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, ((o_orderkey * 7919) % 10007) / 10007e0 AS p, o_orderpriority AS site FROM orders)"
SE = """se AS (SELECT event_id, event_type AS site,
    CASE WHEN event_type IN ('error', 'signup') AND event_id % 4 = 0 THEN 0e0 ELSE 150 + value / 10 END AS chol,
    CASE WHEN event_id % 500 = 0 THEN 0e0 ELSE (110 + event_id % 40)::DOUBLE END AS trestbps, (event_id % 2)::DOUBLE AS flag FROM events)"""
DC = """dc AS (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'ckd' || chr(9) WHEN c_acctbal > 0 THEN ' ckd' ELSE 'notckd' END AS cls,
    CASE WHEN c_custkey % 7 = 0 THEN '?' WHEN c_custkey % 11 = 0 THEN '12d' ELSE c_nationkey::VARCHAR END AS num FROM customer)"""
CO = "co AS (SELECT o_orderkey AS row_id, (o_orderkey % 5)::INTEGER AS fold, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"
EF = "ef AS (SELECT vec_id AS row_id, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(64)) + " FROM embeddings)"


def chance_sql(key: str, seed: int) -> str:
    x = f"(({key} * 1000003 + {seed * 7919 + 12345}) % 2147483647)"
    return f"((({x} * {x}) % 2147483647) * 48271) % 2147483647"
