"""Corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm import lines, nearcopies, packing, toxicity
from marrow.llm.queries import fitted_toxicity, word_tokenizer
from marrow.llm.shared import table, unused, work_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 stay."""
    model = fitted_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    name = unused(docs, "_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; text and n_chars are those without the lines that it loses."""
    names = tuple(unused(docs, name) for name in ("_n_lines", "_n_dropped", "_kept"))
    out = lines.dedup_lines(docs, names=names)
    changed = F.col(names[1]) > 0
    out = out.withColumn("text", F.when(changed, F.col(names[2])).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest doc_id stays."""
    return nearcopies.keep_one(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("packing", pack_windows),
]

#: Scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}")
    return docs
