"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint is cut into 16 segments of 4 bits, and the segments' bit counts are a point with 16
coordinates. The Manhattan distance of two points never exceeds the number of differing bits, so
fingerprints within two bits lie within Manhattan distance two. On the integer grid such points are
equal or meet in a cell that is at most one step from each: the range join therefore puts every distinct
fingerprint into its own cell and the up to 32 cells one step away, joins on the cell, and verifies the
bits of each candidate pair exactly.

A cell that holds more than ``hot_cell`` fingerprints is not paired. Its fingerprints are linked exactly
and without pairs: two fingerprints differ in at most two bits if and only if they share a value within
one bit of both, so each is posted under its 65 such values and linked to the smallest one posted there.
Both ways give the same components.

Equal fingerprints are one node before any join, so groups of exact copies cost nothing.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like any
other; rows with a null doc_id get a component but no row is named by them, unless a component has no
id at all (then it is null); repeated doc_ids are rows like any others; an empty table gives an empty
result; other columns are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm.components import components
from marrow.llm.shared import join_hot, remove, unused, work_dir, written

SEED = 42
SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 16
HOT_CELL = 64
#: Shingle hashes whose bits are counted at a time.
CHUNK = 16_384

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes (uint64), as a signed 64-bit number; 0 if there are none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A signed 64-bit fingerprint; a bit is set if it is set in over half the shingles' hashes."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist() if len(words) >= shingle else [len(line)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, columns: list[str], shingle: int = SHINGLE, text_col: str = "text", name: str = "fp") -> DataFrame:
    """columns of docs, and the fingerprint (long) as name."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t if isinstance(t, str) else None, shingle) for t in texts], dtype="int64")

    return docs.select(*columns, fp(F.col(text_col)).alias(name))


def embedding(fp: Column, segments: int = SEGMENTS) -> list[Column]:
    """The segments' bit counts, from the lowest bits up."""
    width = 64 // segments
    return [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND((1 << width) - 1)) for i in range(segments)]


def _cells(fp: Column, segments: int) -> Column:
    """The point's own cell and all cells one step away, each as one number, with the side they lie on.

    A coordinate is at most 64 / segments <= 4 here, so a cell is a number of base 8 for each segment.
    """
    coordinates = embedding(fp, segments)
    # 16 coordinates of 3 bits fit in a long.
    own = F.lit(0).cast("long")
    for i, c in enumerate(coordinates):
        own = own + c.cast("long") * F.lit(1 << (3 * i)).cast("long")
    up = [F.when(c < 64 // segments, F.lit(1 << (3 * i)).cast("long")) for i, c in enumerate(coordinates)]
    down = [F.when(c > 0, F.lit(-(1 << (3 * i))).cast("long")) for i, c in enumerate(coordinates)]
    steps = F.filter(F.array(F.lit(0).cast("long"), *up, *down), lambda s: s.isNotNull())
    return F.transform(steps, lambda s: F.struct((own + s).alias("cell"), F.signum(s).cast("int").alias("side")))


def links(distinct: DataFrame, folder: str, max_bits: int = MAX_BITS, segments: int = SEGMENTS, hot_cell: int = HOT_CELL) -> DataFrame:
    """u, v: links that connect exactly the fingerprints of distinct (fp) that chains of at most max_bits steps connect."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grid's steps cover at most two bits")
    posted = distinct.select("fp", F.explode(_cells(F.col("fp"), segments)).alias("at")).select("fp", "at.cell", "at.side")
    posted = written(posted, f"{folder}/cells")
    sizes = posted.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(f"n > {int(hot_cell)}")
    hot = written(sizes.select("cell"), f"{folder}/hot")
    cool = posted.join(hot, "cell", "left_anti")
    a, b = cool.alias("a"), cool.alias("b")
    # Sides that two points within distance two can meet on: own-own, own-down, up-up, up-down.
    meet = ((F.col("a.side") == 0) & (F.col("b.side") <= 0)) | ((F.col("a.side") == 1) & (F.col("b.side") != 0))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    pairs = a.join(b, F.col("a.cell") == F.col("b.cell")).where(meet & (F.col("a.fp") != F.col("b.fp")) & near).select(F.greatest("a.fp", "b.fp").alias("u"), F.least("a.fp", "b.fp").alias("v")).distinct()
    if hot.isEmpty():
        return pairs
    crowded = posted.join(hot, "cell", "left_semi").select("fp").distinct()
    balls = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64 if max_bits else 0)])).alias("value"))
    if max_bits == 1:
        # Of two values within one bit, one is the other's own; other meetings are two bits apart.
        own = crowded.select(F.col("fp").alias("value"))
        return pairs.unionByName(balls.join(own, "value").where("fp <> value").select(F.col("fp").alias("u"), F.col("value").alias("v")))
    least = balls.groupBy("value").agg(F.min("fp").alias("v"))
    return pairs.unionByName(balls.join(least, "value").where("fp <> v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fp (long), component_id (the component's smallest doc_id), root (a fp that names it)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "simhash")
    prints = written(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], shingle), f"{folder}/prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/nodes")
    roots = components(links(nodes.select("fp"), folder, max_bits, hot_cell=hot_cell), folder)
    remove(spark, f"{folder}/cells")
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(rooted.join(names, "root").select("fp", "component_id", "root"), f"{folder}/named")
    return join_hot(prints, named, "fp", ["doc_id"]).select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays."""
    folder = work_dir(docs.sparkSession, "keep")
    found = written(near_duplicates(docs, shingle, max_bits, id_col=id_col, text_col=text_col), f"{folder}/found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("fp"))).alias("first")
    own, id_name, fp_name = unused(docs, "_own"), unused(docs, "_id"), unused(docs, "_fp")
    keepers = written(found.groupBy("root").agg(first).select(F.col("first.doc_id").alias(id_name), F.col("first.fp").alias(fp_name)), f"{folder}/keepers")
    ids = F.col(id_col).cast("long")
    if found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.join(keepers, ids == F.col(id_name), "left_semi")
    # Ids that don't name one row: rows are told apart by their fingerprints, and of rows alike in both one stays.
    whole = fingerprints(docs, docs.columns, shingle, text_col, own)
    kept = whole.join(keepers, ids.eqNullSafe(F.col(id_name)) & (F.col(own) == F.col(fp_name)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)
