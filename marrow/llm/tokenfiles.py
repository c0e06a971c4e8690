"""Files of token ids, one zstandard frame for each document, with a dictionary that all frames share.

A file is one binary value (a row of the ``files`` table, written by Spark, so any store will do):

    magic "MTOK1\\0" | bytes per id (1) | SHA-256 of the dictionary (32) | documents n (8)
    | frame offsets, n + 1 (8 each) | ids before each document in this file, n + 1 (8 each) | frames

All numbers are little-endian. The offsets allow one document to be read without its neighbours. Beside
it are its first row's place (part, number), its doc_ids and its count of ids. The dictionary is trained
once on a bounded sample of serialised id arrays and kept in the ``dictionary`` table under its hash; a
reader refuses a file whose dictionary hash it doesn't have.

The text is tokenized and compressed in one map; only frames are shuffled, by ranges of doc_id, so files
follow one another in ascending order. Documents with equal ids follow the order of their frames, null
ids come first; a null or empty text is its end id alone; an empty table gives no files; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marrow.llm.shared import remove, written
from marrow.llm.tokens import END_ID, encoded

MAGIC = b"MTOK1\0"
#: Documents whose id arrays train the dictionary, and the bytes of each that are used; both bound the sample.
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Frames' bytes after which a file ends, and those that one task turns into files.
FILE_BYTES = 4_000_000
TASK_BYTES = 8_000_000
FILES = "part int, number int, dictionary string, doc_ids array<long>, tokens long, content binary"


def serialized(ids: np.ndarray, width: int) -> bytes:
    if len(ids) and int(ids.max()) >> (8 * width):
        raise ValueError(f"id {int(ids.max())} doesn't fit in {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; where there are too few samples to train one, the samples themselves as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


@lru_cache(maxsize=4)
def _codecs(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
    held = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held), zstandard.ZstdDecompressor(dict_data=held)


def pack_file(frames: list[bytes], counts: list[int], width: int, digest: bytes) -> bytes:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    before = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<B", width), digest, struct.pack("<Q", len(frames)), offsets.tobytes(), before.tobytes(), *frames])


class TokenFile:
    """Random access to one file's documents."""

    def __init__(self, content: bytes, dictionaries: dict[bytes, bytes]):
        if content[:6] != MAGIC:
            raise ValueError("not a token file")
        self.content, self.width, digest = memoryview(content), content[6], bytes(content[7:39])
        if digest not in dictionaries:
            raise ValueError(f"no dictionary has the hash {digest.hex()}")
        (n,) = struct.unpack_from("<Q", content, 39)
        self.offsets = np.frombuffer(content, "<u8", n + 1, 47).astype(np.int64)
        self.before = np.frombuffer(content, "<u8", n + 1, 47 + 8 * (n + 1)).astype(np.int64)
        self.frames = 47 + 16 * (n + 1)
        self.decoder = _codecs(dictionaries[digest])[1]

    def __len__(self) -> int:
        return len(self.before) - 1

    def ids(self, i: int) -> np.ndarray:
        frame = self.content[self.frames + self.offsets[i] : self.frames + self.offsets[i + 1]]
        out = np.frombuffer(self.decoder.decompress(frame), f"<u{self.width}").astype(np.uint32)
        if len(out) != self.before[i + 1] - self.before[i]:
            raise ValueError("a document's length differs from the index")
        return out


def write_token_files(docs: DataFrame, spec: str, path: str, width: int = 2, end_id: int = END_ID, file_bytes: int = FILE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes path/files and path/dictionary. width: bytes per id, 2 for up to 65,536 ids, else 4."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(spec)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [serialized(x, width)[:SAMPLE_BYTES] for x in encoded(shared.value, batch.column(0), end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["part"])

    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text").limit(2 * SAMPLE_DOCS).mapInArrow(sampled, "part binary")
    dictionary = train_dictionary(sorted(bytes(r["part"]) for r in sample.collect()))  # at most 2 x SAMPLE_DOCS x SAMPLE_BYTES
    digest = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(digest.hex(), bytearray(dictionary))], "hash string, content binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _codecs(held.value)[0]
        for batch in batches:
            frames, counts = [], []
            for ids in encoded(shared.value, batch.column(1), end_id):
                frames.append(coder.compress(serialized(ids, width)))
                counts.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "frame", "tokens"])

    # Written once: the sampling of the range partitioner would otherwise tokenize everything again.
    frames = written(docs.mapInArrow(framed, "doc_id long, frame binary, tokens long"), f"{path}/frames")

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held_frames, counts, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def file() -> pa.RecordBatch:
            row = [part, number, digest.hex(), list(ids), sum(counts), pack_file(held_frames, counts, width, digest)]
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[c.split()[0] for c in FILES.split(", ")])

        for batch in batches:
            for doc, frame, n in zip(*(c.to_pylist() for c in batch.columns)):
                held_frames.append(frame)
                counts.append(n)
                ids.append(doc)
                size += len(frame)
                if size >= file_bytes:
                    yield file()
                    number, held_frames, counts, ids, size = number + 1, [], [], [], 0
        if held_frames:
            yield file()

    # The tasks' number follows the bytes, so a task's share stays the same as tables grow.
    parts = max(1, -(-(frames.agg(F.sum(F.octet_length("frame"))).first()[0] or 0) // TASK_BYTES))
    ordered = frames.repartitionByRange(parts, "doc_id", F.xxhash64("frame")).sortWithinPartitions("doc_id", F.xxhash64("frame"), "frame")
    ordered.mapInArrow(filed, FILES).write.mode("overwrite").parquet(f"{path}/files")
    remove(spark, f"{path}/frames")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian uint32), in any order."""
    stored = spark.read.schema("hash string, content binary").parquet(f"{path}/dictionary").collect()  # one row a dictionary
    dictionaries = {bytes.fromhex(r["hash"]): bytes(r["content"]) for r in stored}
    for digest, content in dictionaries.items():
        if hashlib.sha256(content).digest() != digest:
            raise ValueError("a dictionary doesn't have its hash")
    held = spark.sparkContext.broadcast(dictionaries)
    files = spark.read.schema(FILES).parquet(f"{path}/files")

    # Ids before each file: first those of earlier parts, then those of earlier files of its part.
    sizes = files.select("part", "number", "tokens")
    earlier_parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_part"))
    earlier_files = sizes.select("part", "number", F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("in_part"))
    starts = earlier_files.join(earlier_parts, "part").select("part", "number", (F.col("before_part") + F.col("in_part")).alias("first"))
    placed = files.join(starts, ["part", "number"]).select("doc_ids", "first", "content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, first, content in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(content, held.value)
                for at in range(0, len(file), 1000):
                    part = [file.ids(i) for i in range(at, min(at + 1000, len(file)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[at : at + 1000], pa.int64()), pa.array([first + int(file.before[at + i]) for i in range(len(part))], pa.int64()), pa.array([len(x) for x in part], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in part], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return placed.mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")
