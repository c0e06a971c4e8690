"""Line dedup over levelled sorted runs of line hashes.

Texts are read twice. The first pass writes a row for each long line: the document, the line's position, its
128-bit hash, and whether it is the hash's first line in this document. The second pass puts together what
stays.

Documents arrive in batches of about equal size, cut at quantiles of the ids, those with the largest ids first. A
batch is reduced to one row for each distinct hash: the number of documents that hold it and the largest such id. The
batch is merge-joined with the runs so far: hashes that no run holds get the batch's largest id as their
keeper, the others only add to the count. The result is written as a new run of level 0. When a level holds
``fanout`` runs they are merged into one of the next level, so a batch meets only a few runs. After the last
batch the runs say which lines repeat and which document keeps them.

A run is a table bucketed by hash and sorted within its buckets. All runs have the same buckets, so neither
joining a batch with the runs nor merging runs shuffles what was written before: only the new batch moves.
Tables are dropped as soon as they are merged or read for the last time, or when a job fails.

Counting combines on the map side, so a line in a third of all documents reaches the shuffle once a
task. Lines that make up more than 1 / HOT_SHARE of all rows are at most HOT_SHARE, and are broadcast to the rows when
these learn what they lose; the others are joined by hash. Texts are shuffled at most once, by id, to meet the positions
of the lines that they lose; where those are few Spark broadcasts them and texts don't move. Work in a document grows
with its lines times their logarithm, however many it loses.

Defined cases: a null or empty text is one empty line; a line that occurs twice in a document counts
once; every row is a document of its own, and rows that share the largest id all keep the line; rows
with a null id count for repetition, are no keeper, and lose the line if another row keeps it (if none
has an id, all keep it); an empty table gives an empty result; other columns are carried along, whatever
their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.llm.shared import lower_ascii, remove, text_or_empty, unused, work_dir, written

MIN_CHARS = 40
MIN_DOCS = 5
#: At least so many batches, and more where a batch would have more than BATCH_DOCS documents.
BATCHES = 4
BATCH_DOCS = 500_000_000
#: Two, so that runs are merged without a shuffle.
FANOUT = 2
#: At least so many buckets, and one for every BUCKET_DOCS documents.
BUCKETS = 8
BUCKET_DOCS = 100_000
#: A hash in more than one of so many rows of the lines is broadcast.
HOT_SHARE = 1_000
BLANKS = " \t\n\x0b\x0c\r"
RUN_SCHEMA = "hash binary, docs long, keeper long"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def long_lines(docs: DataFrame, text: Column, carried: list[Column], min_chars: int) -> DataFrame:
    """carried, at, hash, first: a row for each line that is long enough; first marks one line of each hash in a document."""
    keys = F.transform(F.split(text, "\n"), lambda line, at: F.struct(line_key(line).alias("key"), at.alias("at")))
    hashed = F.transform(F.filter(keys, lambda x: F.char_length(x["key"]) >= min_chars), lambda x: F.struct(key_hash(x["key"]).alias("hash"), x["at"].alias("at")))
    found = docs.select(*carried, F.array_sort(hashed).alias("_sorted"))
    # A column of its own, so that looking at the line before costs no second sort.
    before = lambda i: F.get("_sorted", i - 1)["hash"]
    marked = F.transform("_sorted", lambda x, i: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), ~x["hash"].eqNullSafe(before(i)).alias("first")))
    return found.select(*[c for c in found.columns if c != "_sorted"], F.inline(marked).alias("at", "hash", "first"))


class LineRuns:
    """The levelled runs: bucketed tables whose files lie below path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.path, self.buckets, self.fanout = spark, path, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self._name, self._written = f"line_run_{uuid.uuid4().hex}", 0

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self._name}_{self._written}"
        run.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.path}/{name}").saveAsTable(name)
        self._written += 1
        self.levels[level].append(name)

    def _dropped(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.path}/{name}")

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).select("hash", "docs", "keeper")

    def rows(self) -> DataFrame:
        """The rows of all runs; a hash has one row in each run that holds it, one of them with its keeper."""
        paths = [f"{self.path}/{name}" for name in self._names()]
        return self.spark.read.schema(RUN_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], RUN_SCHEMA)

    def _merged(self, names: list[str]) -> DataFrame:
        """The runs joined by hash, bucket with bucket; the first two meet without a shuffle."""
        out = self._run(names[0])
        for name in names[1:]:
            more = self._run(name).withColumnsRenamed({"docs": "docs_2", "keeper": "keeper_2"})
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("docs_2", F.lit(0))
            out = out.join(more, "hash", "full_outer").select("hash", docs.alias("docs"), F.coalesce("keeper", "keeper_2").alias("keeper"))
        return out

    def add(self, lines: DataFrame) -> None:
        """lines: doc_id, hash, a row for each document and distinct line. Ids must not exceed those of earlier batches."""
        counted = lines.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        batch = counted.repartition(self.buckets, "hash")
        for name in self._names():
            known = self._run(name).select("hash", F.lit(True).alias("known"))
            batch = batch.join(known, "hash", "left").select("hash", "docs", F.when(F.col("known").isNull(), F.col("keeper")).alias("keeper"))
        self._write(batch, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            self._dropped(old)
            level += 1

    def counted(self, min_docs: int) -> DataFrame:
        """hash, docs, keeper of the lines that at least min_docs documents hold."""
        return self._merged(self._names()).where(F.col("docs") >= min_docs)

    def repeated(self, min_docs: int) -> DataFrame:
        """hash, keeper of the same lines."""
        return self.counted(min_docs).select("hash", "keeper")

    def close(self) -> None:
        for level in self.levels:
            self._dropped(level)
        self.levels = [[]]


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("_n_lines", "_n_dropped", "_kept")
) -> DataFrame:
    """docs with three more columns, called names: lines before dropping, lines dropped, the text without its dropped lines."""
    spark = docs.sparkSession
    folder = work_dir(spark, "lines")
    ids, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    print_ = F.xxhash64(text)  # tells rows that share an id apart
    count = docs.count()
    batches = batches or max(BATCHES, -(-count // BATCH_DOCS))
    cuts = docs.agg(F.percentile_approx(ids, [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    edges = sorted(set(cuts or []))
    batch = reduce(lambda n, e: n + F.when(ids > e, 1).otherwise(0), edges, F.lit(0))

    path = f"{folder}/lines"
    found = long_lines(docs, text, [batch.alias("batch"), ids.alias("doc_id"), print_.alias("print")], min_chars)
    found.write.partitionBy("batch").parquet(path)
    rows = spark.read.schema(found.schema).parquet(path)

    runs = LineRuns(spark, folder, max(BUCKETS, -(-count // BUCKET_DOCS)))
    try:
        for number in reversed(range(len(edges) + 1)):
            runs.add(rows.where((F.col("batch") == number) & F.col("first")).select("doc_id", "hash"))
        repeated = written(runs.counted(min_docs), f"{folder}/repeated")
    finally:
        runs.close()

    often = F.col("docs") * HOT_SHARE > rows.count()  # at most HOT_SHARE hashes
    hot = F.broadcast(repeated.where(often).select("hash", "keeper"))
    cold = repeated.where(~often).select("hash", "keeper")
    line = rows.select("doc_id", "print", "at", "hash")
    met = line.join(hot, "hash").unionByName(line.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash"))
    losers = met.where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))

    drop, drop_id, drop_print, lines = (unused(docs, name) for name in ("_drop", "_drop_id", "_drop_print", "_lines"))
    dropped = losers.groupBy(F.col("doc_id").alias(drop_id), F.col("print").alias(drop_print)).agg(F.collect_set("at").alias(drop))  # at most a document's own lines
    joined = docs.join(dropped, ids.eqNullSafe(F.col(drop_id)) & (print_ == F.col(drop_print)), "left")
    split = joined.select(*[docs[c] for c in docs.columns], drop, F.split(text, "\n").alias(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    kept = F.array_join(F.transform(stay, lambda at: F.get(F.col(lines), at)), "\n")
    n_lines, n_dropped, kept_name = names
    return split.select(
        *docs.columns,
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(drop).isNull(), text).otherwise(kept).alias(kept_name),
    )
