"""Vector code compression: product codes learned by the filtering form of Lloyd's algorithm.

Every partition packs its vectors into blocks and builds, for each of the four parts of a block's vectors, a
kd-tree whose nodes keep their bounding box and the sum and count of their rows. The trees are written once.
A round sends the codebooks (256 entries a part, whatever the table's size) to all tasks; down each tree a
box drops every entry that is nowhere in it nearer than the entry nearest to its middle, and a subtree with one
entry left is assigned whole by its cached sum. What is left at a leaf is compared row by row. A task adds up its own
sums, Spark adds up the tasks', and the driver sees 256 rows a part. All numbers are integers, so the result
depends neither on partitioning nor on the order of rows.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a null vec_id
is kept and sorts last; repeated rows count as often as they occur; with fewer than 256 vectors the codebooks have
as many entries as there are vectors. Vectors of another dimension have codebooks of their own; a dimension that four
doesn't divide is cut as evenly as possible, and parts without components have code 0. Integer
components are held to +-2**24 (|x| up to 16,384), so that no squared distance overflows. An empty table gives an
empty result; other columns are ignored, and without a label column all labels are null.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.shared import join_hot, work_dir, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BOUND = 1 << 24
#: Rows of a leaf, rows and bytes of a block.
LEAF, BLOCK_ROWS, BLOCK_BYTES = 32, 8_192, 16 << 20
FIELDS = ("order", "start", "end", "left", "right", "low", "high", "sums")


def bounds(dim: int) -> list[tuple[int, int]]:
    """Where a vector's parts begin and end."""
    return [(dim * i // PARTS, dim * (i + 1) // PARTS) for i in range(PARTS)]


def kd_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """A node's rows are order[start:end]; nodes split at the median of their widest side; leaves have left = -1."""
    order = np.arange(len(x))
    nodes: list[list] = []
    low, high, sums = [], [], []
    todo = [(0, len(x), -1, 0)]
    while todo:
        start, end, parent, side = todo.pop()
        rows = x[order[start:end]]
        at = len(nodes)
        nodes.append([start, end, -1, -1])
        low.append(rows.min(axis=0, initial=BOUND))
        high.append(rows.max(axis=0, initial=-BOUND))
        sums.append(rows.sum(axis=0, dtype=np.int64))
        if parent >= 0:
            nodes[parent][2 + side] = at
        width = high[-1] - low[-1]
        if end - start > LEAF and width.max(initial=0) > 0:
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(rows[:, width.argmax()], half)]
            todo += [(start + half, end, at, 1), (start, start + half, at, 0)]
    ends = np.array(nodes, np.int32).reshape(-1, 4).T
    return dict(zip(FIELDS, [order.astype(np.int32), *ends, np.array(low, np.int32), np.array(high, np.int32), np.array(sums)]))


def filtered(x: np.ndarray, tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index), and the sums and counts of the entries' rows.

    All nodes of a level are handled together. Doubles hold every number exactly, or else 64-bit integers are used.
    """
    k, d = entries.shape
    most = max(np.abs(tree["low"]).max(initial=0), np.abs(tree["high"]).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 16 * max(d, 1) * int(most) ** 2 < 1 << 53 else np.int64
    z = entries.astype(kind)
    z2 = (z * z).sum(axis=1)
    apart: dict[int, np.ndarray] = {}
    far = np.array(1 << 62).astype(kind)
    order, codes = tree["order"], np.zeros(len(x), np.int16)
    sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    single = np.zeros(len(x), bool)  # rows compared one by one
    node, left_over = np.zeros(1, int), np.ones((1, k), bool)
    while len(node):
        low, high = tree["low"][node].astype(kind), tree["high"][node].astype(kind)
        away = z2 - (low + high) @ z.T
        mid = np.where(left_over, away, far).argmin(axis=1)
        lead = away - away[np.arange(len(node)), mid][:, None]
        for m in np.unique(mid).tolist():
            if m not in apart:
                apart[m] = np.abs(z - z[m]).T
            of = mid == m
            # How much nearer an entry may be anywhere in the box than entry m, at its best corner.
            lead[of] -= (high[of] - low[of]) @ apart[m]
            left_over[of] &= (lead[of] < 0) | ((lead[of] == 0) & (np.arange(k) <= m))
        alone = left_over.sum(axis=1) == 1
        for n, m in zip(node[alone].tolist(), mid[alone].tolist()):
            start, end = tree["start"][n], tree["end"][n]
            codes[order[start:end]] = m
            sums[m] += tree["sums"][n]
            counts[m] += end - start
        leaf = ~alone & (tree["left"][node] < 0)
        for n, held in zip(node[leaf].tolist(), left_over[leaf]):
            rows, among = order[tree["start"][n] : tree["end"][n]], np.flatnonzero(held)
            codes[rows] = among[(z2[among] - 2 * (x[rows].astype(kind) @ z[among].T)).argmin(axis=1)]
            single[rows] = True
        inner = ~alone & ~leaf
        node = np.concatenate([tree["left"][node[inner]], tree["right"][node[inner]]])
        left_over = np.concatenate([left_over[inner]] * 2)
    rest = codes[single]
    counts += np.bincount(rest, minlength=k)
    for j in range(d):  # sums of at most a block's rows, exact in doubles
        sums[:, j] += np.bincount(rest, x[single, j], k).astype(np.int64)
    return codes, sums, counts


def _to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _packed(dim: int, ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    trees = {f"{part}_{name}": a for part, (b, e) in enumerate(bounds(dim)) for name, a in kd_tree(x[:, b:e]).items()}
    one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), one(ids), one(labels), pa.array([_to_bytes({"x": x} | trees)], pa.binary())], names=["dim", "ids", "labels", "trees"])


def forest_of(vectors: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """dim, ids, labels, trees: blocks of vectors with their kd-trees, written to folder. vectors: vec_id, label, vector."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, labels, xs = zip(*held.pop(dim))
            return _packed(dim, pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(xs))

        for batch in batches:
            lists = batch.column("vector")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                most = max(1, min(block_rows, BLOCK_BYTES // (4 * dim + 1)))
                for i in range(0, len(at), most):
                    rows = pa.array(at[i : i + most])
                    x = lists.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
                    x = np.clip(np.floor(x * SCALE), -BOUND, BOUND).astype(np.int32)
                    held.setdefault(dim, []).append((batch.column("vec_id").take(rows), batch.column("label").take(rows), x))
                    if sum(len(h[2]) for h in held[dim]) >= most:
                        yield flush(dim)
            while sum(h[2].nbytes for hs in held.values() for h in hs) > 2 * BLOCK_BYTES:  # many dimensions
                yield flush(max(held, key=lambda d: len(held[d])))
        for dim in sorted(held):
            yield flush(dim)

    label = vectors.schema["label"].dataType.simpleString()
    return written(vectors.mapInArrow(packed, f"dim int, ids array<long>, labels array<{label}>, trees binary"), folder)


def _each_block(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[dict]]]:
    for i in range(batch.num_rows):
        with np.load(io.BytesIO(batch.column("trees")[i].as_py())) as a:
            yield i, batch.column("dim")[i].as_py(), a["x"], [{name: a[f"{part}_{name}"] for name in FIELDS} for part in range(PARTS)]


def lloyd(forest: DataFrame, codebooks: dict[int, list[np.ndarray]], rounds: int) -> dict[int, list[np.ndarray]]:
    """The codebooks (by dimension and part) after so many rounds; one aggregate a round."""
    spark = forest.sparkSession
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(codebooks)  # 256 entries a dimension

        def summed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], list[np.ndarray]] = {}
            for batch in batches:
                for _, dim, x, trees in _each_block(batch):
                    for part, (b, e) in enumerate(bounds(dim)):
                        _, sums, counts = filtered(x[:, b:e], trees[part], sent.value[dim][part])
                        held = total.setdefault((dim, part), [0, 0])
                        held[0], held[1] = held[0] + sums, held[1] + counts
            for (dim, part), (sums, counts) in total.items():
                used = np.flatnonzero(counts)
                rows = [[dim] * len(used), [part] * len(used), used, counts[used], sums[used].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["dim", "part", "entry", "n", "sums"])

        tasks = forest.mapInArrow(summed, "dim int, part int, entry int, n long, sums array<long>")
        keys = ["dim", "part", "entry"]
        places = tasks.select(*keys, F.posexplode(F.array_append("sums", F.col("n"))).alias("place", "v"))
        new = {dim: [part.copy() for part in parts] for dim, parts in codebooks.items()}
        found = places.groupBy(*keys, "place").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s"))
        for r in found.collect():  # 256 rows a part
            *sums, n = (v for _, v in r["s"])
            new[r["dim"]][r["part"]][r["entry"]] = [s // n for s in sums]
        sent.unpersist()
        codebooks = new
    return codebooks


def digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for part in parts for entry in part.tolist() for v in entry).encode()).hexdigest()


def _first(vectors: DataFrame, dim: int, entries: int) -> list[np.ndarray]:
    """The vectors of the smallest vec_ids, cut into parts."""
    rows = vectors.where(F.size("vector") == dim).orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()
    x = np.clip(np.floor(np.array([r["vector"] for r in rows], float).reshape(len(rows), dim) * SCALE), -BOUND, BOUND).astype(np.int64)
    return [x[:, b:e] for b, e in bounds(dim)]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    finite: Callable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return out.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", entries: int = ENTRIES, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, code, error, codebooks_sha256; the codebooks by dimension and part)."""
    spark, folder = vectors.sparkSession, work_dir(vectors.sparkSession, "codes")
    used = usable(vectors, id_col, vector_col, label_col)
    forest = forest_of(used, f"{folder}/forest", block_rows)
    dims = sorted(r["dim"] for r in forest.select("dim").distinct().collect())
    codebooks = lloyd(forest, {dim: _first(used, dim, entries) for dim in dims}, rounds)
    sent = spark.sparkContext.broadcast((codebooks, {dim: digest(parts) for dim, parts in codebooks.items()}))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = sent.value
        for batch in batches:
            for i, dim, x, trees in _each_block(batch):
                codes, error = [], np.zeros(len(x), np.int64)
                for part, (b, e) in enumerate(bounds(dim)):
                    codes.append(filtered(x[:, b:e], trees[part], books[dim][part])[0])
                    error += ((x[:, b:e].astype(np.int64) - books[dim][part][codes[-1]]) ** 2).sum(axis=1)
                text = [c.tobytes().hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                own = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([own("ids"), own("labels"), pa.array(text, pa.string()), pa.array(error), pa.array([digests[dim]] * len(x), pa.string())], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    label = used.schema["label"].dataType.simpleString()
    rows = forest.mapInArrow(coded, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")
    return written(rows, f"{folder}/codes"), codebooks


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (nulls together); a label's rows are dealt to parts."""
    keyed = codes.withColumn("_label", F.struct("label"))  # structs with null fields are equal
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return join_hot(keyed, sums, "_label", ["vec_id", "code"]).drop("_label")
