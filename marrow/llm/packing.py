"""Packing of documents into token windows by best-fit decreasing.

A document of more than a window is first cut into full windows; its tail is an item. Items are taken
from the longest to the shortest, and each goes into the open window with the least room that still
holds it. A segment tree over the remaining capacities 0..window finds that window in log(window)
steps. Windows that stay more than ``slack`` empty are joined end to end and cut again at the window
length; what is left at the end is cut at powers of two, which need no padding.

Packing is a map over partitions: a task packs its own documents, at most ``group`` tails at a time, so
nothing is shuffled, memory is bounded, and a lost task is simply run again. Sequence ids hold the
partition's number, so tasks need not agree on anything.

Defined cases: a null or empty text is a document with its end id alone; repeated and null doc_ids are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.tokens import END_ID, encoded

WINDOW = 4096
#: Tails that are packed together.
GROUP = 20_000
#: Windows with a larger share of padding are joined and cut again.
SLACK = 1 / 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is at least as large as asked."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, sequence) of the tightest window with room for need."""
        count, at = self.count, need + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):  # up until a right sibling holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        sequence = self.open[capacity].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, sequence


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """For each window the positions of its items; every length is 1..window."""
    tree, windows = CapacityTree(window), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            windows.append([])
            found = (window, len(windows) - 1)
        room, at = found
        windows[at].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], at)
    return windows


def _powers(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


def laid_out(lengths: list[int], window: int, slack: float = SLACK) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in the item, length)."""
    full, rest = [], []
    for items in best_fit_decreasing(lengths, window):
        whole = [(i, 0, lengths[i]) for i in items]
        used = sum(lengths[i] for i in items)
        if window - used <= slack * window or used & (used - 1) == 0:
            full.append(whole)
        else:
            rest += whole
    left = sum(n for _, _, n in rest)
    sizes = [window] * (left // window) + _powers(left % window)
    pieces, at = iter(rest), (0, 0, 0)
    for size in sizes:
        sequence = []
        while size:
            if not at[2]:
                at = next(pieces)
            i, start, n = at
            take = min(n, size)
            sequence.append((i, start, take))
            at, size = (i, start + take, n - take), size - take
        full.append(sequence)
    return full


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(docs: DataFrame, spec: str, window: int = WINDOW, group: int = GROUP, slack: float = SLACK, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. spec: a tokenizer's JSON."""
    if window < 1:
        raise ValueError("window must be positive")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        sequences, rows, tails = 0, [], []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        def place() -> list[tuple]:
            nonlocal sequences, tails
            out = []
            for sequence in laid_out([len(t[3]) for t in tails], window, slack):
                offset = 0
                for i, start, n in sequence:
                    doc, before, total, ids = tails[i]
                    out.append((doc, before + start, n, _crc(ids[start : start + n]), total, base + sequences, offset))
                    offset += n
                sequences += 1
            tails = []
            return out

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(shared.value, batch.column(1), end_id)):
                cut = len(ids) // window * window
                for at in range(0, cut, window):
                    rows.append((doc, at, window, _crc(ids[at : at + window]), len(ids), base + sequences, 0))
                    sequences += 1
                if cut < len(ids):
                    tails.append((doc, cut, len(ids), ids[cut:].astype(np.uint32)))
                if len(tails) >= group:
                    rows += place()
                if len(rows) >= 20_000:
                    yield flush(rows)
                    rows = []
        rows += place()
        yield flush(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packed, SCHEMA)
