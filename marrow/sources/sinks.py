"""Byte-identical sinks: gzip CSV of any size, and JSON reports."""

from __future__ import annotations

import gzip
import io
import json
import uuid
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrow.operators.integrity import json_safe
from marrow.operators.storage import step_folder, stored

#: Rows of a gzip member, which a task compresses.
MEMBER_ROWS = 100_000


def gzip_csv(df: DataFrame, path: Path, order: list[str], member_rows: int = MEMBER_ROWS) -> None:
    """One gzip CSV in a fixed order, with the same bytes on every run and partitioning.

    Rows are sorted and numbered on Spark, so many to a gzip member; tasks compress members, and a gzip file may be members one
    after another. The driver appends them one at a time and renames the finished file, so a file is whole or absent.
    """
    spark, columns = df.sparkSession, df.columns
    folder = step_folder(spark, "csv")
    # Rows alike in order are told apart by the other columns, or else are the same row.
    by = [F.col(f"`{c}`") for c in [*order, *(c for c in columns if c not in order)]]
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), f"{folder}/rows")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # The number within a partition is that of its id, whose upper bits count partitions.
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = rows.join(F.broadcast(before), "_part").withColumn("_place", place).withColumn("_member", F.floor(place / member_rows)).drop("_part", "_at", "_before")

    def compressed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        text = pdf.sort_values("_place")[columns].to_csv(index=False, header=not key[0], lineterminator="\n")
        return pd.DataFrame({"member": [key[0]], "data": [_member(text)]})

    members = stored(placed.groupBy("_member").applyInPandas(compressed, "member long, data binary"), f"{folder}/members")
    target = Path(path)
    unfinished = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        with unfinished.open("wb") as out:
            empty = True
            for r in members.orderBy("member").toLocalIterator():  # a few members at a time
                out.write(r["data"])
                empty = False
            if empty:
                out.write(_member(",".join(columns) + "\n"))
        unfinished.replace(target)
    finally:
        unfinished.unlink(missing_ok=True)


def _member(text: str) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0, filename="") as f:
        f.write(text.encode())
    return out.getvalue()


def json_report(document: dict, path: Path) -> None:
    """Sorted keys, two blanks of indent, no NaN."""
    Path(path).write_text(json.dumps(json_safe(document), sort_keys=True, indent=2, allow_nan=False) + "\n")
