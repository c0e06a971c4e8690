"""Reading tables: CSV with and without header, several tagged files, JSON, and markdown dictionaries."""

from __future__ import annotations

import hashlib
import shutil
import urllib.parse
import urllib.request
import uuid
import zipfile
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The texts that CSV readers for data frames take for a missing value, beside the empty one.
NA_TEXTS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, null: str = "") -> DataFrame:
    """Plain or gzip CSV under an explicit schema; the usual texts for missing become NULL in string columns."""
    df = spark.read.csv(path, schema=schema, header=header, nullValue=null, mode="FAILFAST", ignoreLeadingWhiteSpace=True)
    strings = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.col(c).isin(*NA_TEXTS), None).otherwise(F.col(c)) for c in strings})


def tagged(spark: SparkSession, paths: dict[str, str], schema: str, tag: str = "site", **options) -> DataFrame:
    """The union of files, each with its tag as a column."""
    return reduce(DataFrame.unionByName, [csv(spark, p, schema, **options).withColumn(tag, F.lit(t)) for t, p in paths.items()])


def with_line_numbers(scan: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of a scan of files numbered from 0 in file order, however the files are split.

    Two steps: rows before a split, from the splits' counts, and a row's place within its split.
    """
    split = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    rows = scan.select("*", *split, F.monotonically_increasing_id().alias("_order"))
    sizes = scan.select(*split).groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_n"))  # a row a split
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_order")))
    joined = placed.join(sizes.select("_file", "_at", before.alias("_before")), ["_file", "_at"])
    return joined.withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_file", "_at", "_order", "_place", "_before")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """section, column, label, unit of a markdown file with a table below each heading."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return dictionary_rows(lines)


def dictionary_rows(lines: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The same from line, text rows of one document, or of one for each value of keys; a document is small, so its lines are one window."""
    section = F.last(F.when(F.col("text").rlike("^##+ "), F.regexp_extract("text", r"^##+\s+(.*?)\s*$", 1)), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    cells = F.split(F.regexp_replace("text", r"^\s*\||\|\s*$", ""), r"\|")
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    rows = lines.withColumn("section", section).where(F.col("text").rlike(r"^\s*\|")).withColumn("cells", cells)
    named = rows.select(*keys, "section", F.regexp_replace(cell(0), "`", "").alias("column"), cell(1).alias("label"), cell(2).alias("unit"))
    return named.where(~F.col("column").rlike(r"^:?-+:?$") & (F.lower("column") != "column"))


def sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class PinError(ValueError):
    """A file doesn't have its pinned hash."""


def _verified(folder: Path, files: dict[str, str | None]) -> dict[str, str]:
    status = {}
    for name, pin in files.items():
        if not (folder / name).exists():
            raise FileNotFoundError(f"{name} is missing after the download")
        if pin and sha256(folder / name) != pin:
            raise PinError(f"{name} doesn't have its pinned hash")
        status[name] = "OK" if pin else "UNPINNED"
    return status


def fetch(target: Path, files: dict[str, str | None], download: Callable[[Path], None], force: bool = False) -> dict[str, str]:
    """Makes target hold all files, checked. files: name -> SHA-256 or None.

    A complete target is checked and never downloaded over, so a changed file is an error, not a new download. Else the download
    fills a folder beside target, whose files are checked and renamed into place, those last named last; one that
    is interrupted or fails its check leaves target as it was. Status by name: OK or UNPINNED.
    """
    if not force and all((target / f).exists() for f in files):
        return _verified(target, files)
    side = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    side.mkdir(parents=True)
    try:
        download(side)
        status = _verified(side, files)
        target.mkdir(parents=True, exist_ok=True)
        for name in files:
            (side / name).replace(target / name)
        return status
    finally:
        shutil.rmtree(side, ignore_errors=True)


def copied_from(source: str, files: list[str]) -> Callable[[Path], None]:
    """A download of files from below a URL or folder; a zip archive is unpacked for those it should hold."""

    def download(target: Path) -> None:
        base = source if "://" in source else Path(source).resolve().as_uri()
        if base.endswith(".zip"):
            with urllib.request.urlopen(base) as src, (target / "archive.zip").open("wb") as dst:
                shutil.copyfileobj(src, dst)
            return extract(target / "archive.zip", target, files)
        for name in files:
            with urllib.request.urlopen(f"{base.rstrip('/')}/{urllib.parse.quote(name)}") as src, (target / name).open("wb") as dst:
                shutil.copyfileobj(src, dst)

    return download


def extract(archive: Path, target: Path, wanted: list[str]) -> None:
    """The archive's members with these base names, wherever they lie in it; a missing one is an error."""
    with zipfile.ZipFile(archive) as z:
        members = {Path(m).name: m for m in z.namelist() if Path(m).name in wanted}
        if lost := sorted(set(wanted) - set(members)):
            raise FileNotFoundError(f"{archive.name} has no {', '.join(lost)}")
        for name, member in members.items():
            with z.open(member) as src, (target / name).open("wb") as dst:
                shutil.copyfileobj(src, dst)
