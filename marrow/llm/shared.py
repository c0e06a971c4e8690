"""What the operators share: work folders, written tables, fixed-size hashing of ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only used where a local session names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/marrow"
#: Parts that the rows of one key are dealt to.
SALTS = 64
#: monotonically_increasing_id() has a row's place within its partition in so many bits, the partition above them.
PLACE_BITS = 33
#: Bits of bitmap_construct_agg().
BITMAP = 32_768
#: The session's setting by which an action's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends at the files."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a work folder that no plan reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it an action's shuffle files go when it ends; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def numbered(df: DataFrame, row: str, part: str) -> DataFrame:
    """df with row, a number of its own for each row, and part, its partition."""
    return df.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, PLACE_BITS))


def in_parts(df: DataFrame, path: str, part: str) -> DataFrame:
    """df written below path in buckets of part, and read again: picked() finds its rows where they lie. Nothing is shuffled, as a task has few parts."""
    spark, name = df.sparkSession, f"rows_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), part).option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return out


def picked(rows: DataFrame, ids: DataFrame, row: str, part: str) -> DataFrame:
    """The rows of in_parts() whose number is in ids (one column). Ids are shuffled as bits, rows aren't moved. row, part: see numbered()."""
    of, sets = unused(rows, "_of"), unused(rows, "_bits")
    place = F.col(row).bitwiseAND((1 << PLACE_BITS) - 1)
    at = ids.toDF(row).select(F.shiftright(row, PLACE_BITS).alias(of), F.floor(place / BITMAP).alias("slice"), (place % BITMAP).alias("bit"))
    slices = at.groupBy(of, "slice").agg(F.bitmap_construct_agg("bit").alias("bits"))
    # A part's bits are as many as the rows that one task wrote.
    bits = slices.groupBy(of).agg(F.map_from_entries(F.collect_list(F.struct("slice", "bits"))).alias(sets))
    byte = F.substring(F.element_at(sets, F.floor(place / BITMAP)), (F.floor(place % BITMAP / 8) + 1).cast("int"), F.lit(1))
    held = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (place % 8).cast("int")) == 1
    return rows.join(bits.hint("shuffle_hash"), (F.col(part) == F.col(of)) & held, "left_semi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it so that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with keyed (one row a key), where one key may hold most of the rows.

    A key's rows are dealt to SALTS parts by the columns spread; the key's one row is sent to those parts that it has.
    """
    salted = rows.withColumn("_salt", salt(*spread))
    cells = salted.select(key, "_salt").distinct().join(keyed, key, how)
    return salted.join(cells, [key, "_salt"]).drop("_salt")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else, whatever the locale."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text."""
    return F.crc32(F.col(column).cast("string"))
