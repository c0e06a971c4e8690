"""One gzip file of many members: the same bytes however the rows lie, and a whole file or none."""

import gzip

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrow.sources import sinks


def test_bytes_do_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(2500).select(F.pmod(F.col("id") * 7919, F.lit(2500)).alias("k"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") / 8).alias("v"), F.concat(F.lit('a "quoted", '), F.col("id") % 5, F.lit("\n")).alias("s"))
    files = []
    for name, parts in (("a", 1), ("b", 7), ("c", 3)):
        sinks.gzip_csv(df.repartition(parts, "v"), tmp_path / name, ["k"], member_rows=400)
        files.append((tmp_path / name).read_bytes())
    assert files[0] == files[1] == files[2] and files[0].count(b"\x1f\x8b\x08\x00\x00\x00\x00\x00") >= 7
    want = df.orderBy("k").toPandas()
    assert gzip.decompress(files[0]).decode() == want.to_csv(index=False, lineterminator="\n")
    assert pd.read_csv(tmp_path / "a", compression="gzip").shape == (2500, 3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]


def test_ties_in_the_order_are_settled_by_the_other_columns(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), (F.col("id") * 31 % 100).alias("v"))
    for name, parts in (("a", 1), ("b", 5)):
        sinks.gzip_csv(df.repartition(parts), tmp_path / name, ["k"], member_rows=50)
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_an_empty_table_keeps_its_header(spark, tmp_path):
    sinks.gzip_csv(spark.range(0).toDF("k"), tmp_path / "e", ["k"])
    assert gzip.decompress((tmp_path / "e").read_bytes()) == b"k\n"


def test_a_failure_leaves_the_old_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"old")
    broken = spark.range(10).select(F.col("id").alias("k"), F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise("x").alias("v"))
    with pytest.raises(Exception):
        sinks.gzip_csv(broken, tmp_path / "a", ["k"])
    assert [p.name for p in tmp_path.iterdir()] == ["a"] and (tmp_path / "a").read_bytes() == b"old"
