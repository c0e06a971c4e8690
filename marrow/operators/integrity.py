"""Hashes of artifacts, comparison with a manifest, and fingerprints of models."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOLERANCE = 1e-12


#: What a manifest names, below the root.
ARTIFACTS = ("models/*/model.json", "models/*/metrics.json", "models/*/external.json", "cleaned/*.csv.gz")


#: Bytes that a task reads at a time, and those of a chunk that has a hash of its own.
READ_BYTES, CHUNK_BYTES = 1 << 20, 64 << 20


def _found(spark: SparkSession, root: Path, patterns: tuple[str, ...]) -> DataFrame:
    """path (below root), file, bytes, a task a file; root is a folder that all executors share."""
    root = Path(root).resolve()
    files = sorted({p for pattern in patterns for p in root.glob(pattern) if p.is_file()})
    rows = [(p.relative_to(root).as_posix(), str(p), p.stat().st_size) for p in files]
    return spark.createDataFrame(rows, "path string, file string, bytes long").repartition(max(1, len(rows)), "path")


def _digest(file: str, start: int, length: int) -> str:
    out = hashlib.sha256()
    with open(file, "rb") as f:
        f.seek(start)
        while length > 0 and (part := f.read(min(READ_BYTES, length))):
            out.update(part)
            length -= len(part)
    return out.hexdigest()


@F.pandas_udf(StringType())
def _digests(file: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([_digest(*r) for r in zip(file, start, length)], dtype=object)


def artifacts(spark: SparkSession, root: Path, patterns: tuple[str, ...] = ARTIFACTS) -> DataFrame:
    """path (below root), sha256 of the named artifacts that exist; other files below root aren't part of it. Files are read piece by piece."""
    return _found(spark, root, patterns).select("path", _digests("file", F.lit(0).cast("long"), "bytes").alias("sha256"))


def hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below root), sha256 of every file at any depth whose name matches."""
    return artifacts(spark, Path(root), (f"**/{pattern}",))


def chunk_roots(spark: SparkSession, root: Path, patterns: tuple[str, ...] = ARTIFACTS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, bytes, root: SHA-256 of the hex SHA-256s of a file's chunks in order, which tasks find side by side, whatever its size."""
    starts = F.explode_outer(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(chunk_bytes).cast("long")))
    chunks = _found(spark, root, patterns).select("path", "file", "bytes", starts.alias("start")).repartition("path", "start")
    hashed = chunks.select("path", "bytes", "start", _digests("file", "start", F.least(F.lit(chunk_bytes).cast("long"), F.col("bytes") - F.col("start"))).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "h"))), lambda c: c["h"]), "")
    return hashed.groupBy("path", "bytes").agg(F.sha2(joined, 256).alias("root"))


def safe_path(root: Path, path: str) -> Path:
    """path below root; absolute paths and ones that lead outside are errors."""
    full = (root / path).resolve()
    if Path(path).is_absolute() or not full.is_relative_to(root.resolve()):
        raise ValueError(f"path leaves the root: {path}")
    return full


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: OK, TAMPERED, MISSING, or UNLISTED for files that the manifest doesn't name. Both: path, sha256."""
    e, a = expected.select("path", F.col("sha256").alias("_e")), actual.select(F.col("path").alias("_p"), F.col("sha256").alias("_a"))
    joined = e.join(a, F.col("path") == F.col("_p"), "full_outer")
    status = F.when(F.col("path").isNull(), "UNLISTED").when(F.col("_p").isNull(), "MISSING").when(F.col("_e") == F.col("_a"), "OK").otherwise("TAMPERED")
    return joined.select(F.coalesce("path", "_p").alias("path"), status.alias("status"))


def manifest(hashed: DataFrame, meta: dict) -> dict:
    """A few artifacts' hashes with their metadata; meant for files by the dozen, not for data."""
    return {"artifacts": {r["path"]: r["sha256"] for r in hashed.orderBy("path").collect()}, "meta": meta}


def canonical(document: dict) -> bytes:
    return json.dumps(json_safe(document), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def json_safe(x):
    """NaN and infinities to null, at any depth."""
    if isinstance(x, dict):
        return {k: json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def fingerprint(candidate: DataFrame, references: DataFrame) -> DataFrame:
    """model, distance, matches: the largest gap between the candidate's and a model's canary scores.

    candidate: canary, p; references: model, canary, p. A canary without a partner is an infinite gap; a
    model matches if it alone lies within the tolerance.
    """
    models = references.select("model").distinct()
    # A handful of models with a handful of canaries each.
    wanted = references.select("model", "canary", F.col("p").alias("_r"))
    asked = candidate.select(F.col("canary").alias("_c"), F.col("p").alias("_p")).crossJoin(F.broadcast(models.withColumnRenamed("model", "_m")))
    joined = wanted.join(asked, (F.col("model") == F.col("_m")) & (F.col("canary") == F.col("_c")), "full_outer")
    gap = F.coalesce(F.abs(F.col("_r") - F.col("_p")), F.lit(float("inf")))
    d = joined.groupBy(F.coalesce("model", "_m").alias("model")).agg(F.max(gap).alias("distance"))
    near = d.agg(F.count_if(F.col("distance") <= TOLERANCE).alias("near"))
    return d.crossJoin(near).select("model", "distance", ((F.col("distance") <= TOLERANCE) & (F.col("near") == 1)).alias("matches"))
