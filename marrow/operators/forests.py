"""Boosted trees of tables of any size, grown level by level from histograms that Spark sums.

Cut points of all features come from one pass: bounded sets of values where a feature has few, quantile
sketches that merge where it has many. Rows are then kept as bin codes. All fits of a call (folds, settings)
grow in step on the one binned table: a level is one aggregate of gradients and Hessians by (fit, node, feature,
bin), and each node's best split is found by the task that holds its histogram, so the driver sees a row a node.
Rows carry every fit's margin; they are written anew after KEPT trees, and in between tasks walk the trees since.

Gradients are summed as integers (fixed point), so the trees don't depend on partitioning or the order of rows, and a
lost executor repeats the same numbers. Nodes, splits, missing values and leaves are as in ``boosting.fit_forest``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.operators.boosting import LAMBDA, MAX_BINS, POINT, Forest, best_split, gradients
from marrow.operators.storage import stored

#: Trees that tasks walk before the margins are written again.
KEPT = 16
#: Relative rank error of quantile sketches is 1 / ACCURACY.
ACCURACY = 10_000


@dataclass(frozen=True)
class Fit:
    """train: an SQL condition on the binned table's kept columns."""

    depth: int
    trees: int
    rate: float
    train: str = "true"


@dataclass
class _Node:
    """A node of a tree on bin codes; number: its index among the tree's nodes in the order they were made."""

    number: int
    level: int
    g: int
    h: int
    feature: int = -1
    bin: int = 0
    missing_left: bool = True
    children: tuple["_Node", "_Node"] | None = None


@dataclass
class _Tree:
    nodes: list[_Node] = field(default_factory=list)

    def add(self, level: int, g: int, h: int) -> _Node:
        self.nodes.append(_Node(len(self.nodes), level, g, h))
        return self.nodes[-1]

    def arrays(self, rate: float) -> tuple[np.ndarray, ...]:
        """feature, bin, missing goes left, left child (right is next), value of every node."""
        rows = [(n.feature, n.bin, n.missing_left, n.children[0].number if n.children else -1, leaf_value(n.g, n.h, rate)) for n in self.nodes]
        f, b, m, left, v = zip(*rows)
        return np.array(f), np.array(b), np.array(m, bool), np.array(left), np.array(v)


def leaf_value(g: int, h: int, rate: float) -> float:
    return float(np.float32(-rate * (g / 2**POINT) / (h / 2**POINT + LAMBDA)))


def _leaves(tree: tuple[np.ndarray, ...], codes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The node each row ends at; missing values have the code widths[feature]."""
    f, b, m, left, _ = tree
    at, every = np.zeros(len(codes), int), np.arange(len(codes))
    while (inner := f[at] >= 0).any():
        j = np.maximum(f[at], 0)
        code = codes[every, j]
        goes_left = np.where(code == widths[j], m[at], code <= b[at])
        at = np.where(inner, left[at] + ~goes_left, at)
    return at


# Cut points ----------------------------------------------------------------------------------------


def cut_table(df: DataFrame, features: list[str], bins: int = MAX_BINS, accuracy: int = ACCURACY) -> DataFrame:
    """feature (its place), cuts: ascending cut points in single precision, a row a feature.

    Up to ``bins`` distinct values: midpoints of neighbours. More: midpoints of the values at evenly spaced ranks,
    from a sketch a partition that Spark merges, each rank right to within 1 / accuracy of the rows.
    """
    spark, k = df.sparkSession, len(features)
    x = df.select(*[F.col(f"`{c}`").cast("float").alias(f"c{j}") for j, c in enumerate(features)])
    x = x.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) for c in x.columns])

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's distinct values of each feature; none and a mark where there are more than bins."""
        seen: list[np.ndarray | None] = [np.zeros(0, np.float32)] * k
        for batch in batches:
            for j in range(k):
                if seen[j] is not None:
                    own = np.unique(np.concatenate([seen[j], batch.column(j).drop_null().to_numpy()]))
                    seen[j] = own if len(own) <= bins else None
        for j, own in enumerate(seen):
            v = own if own is not None else np.array([np.nan], np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(v), pa.int32()), pa.array(v, pa.float32())], names=["feature", "v"])

    # At most bins + 1 values a feature and partition; equal ones fall together on the map side.
    values = x.mapInArrow(few, "feature int, v float").groupBy("feature", "v").agg(F.lit(1).alias("one"))
    sets = values.groupBy("feature").agg(F.max(F.isnan("v")).alias("many"), F.count(F.lit(1)).alias("n"))
    exact = values.join(F.broadcast(sets.where(~F.col("many") & (F.col("n") <= bins))), "feature", "left_semi")  # a row a feature
    points = [(r["feature"], r["v"]) for r in exact.select("feature", "v").collect()]  # at most bins a feature
    held: dict[int, list[float]] = {}
    for j, v in points:
        held.setdefault(j, []).append(v)
    many = [r["feature"] for r in sets.where(F.col("many") | (F.col("n") > bins)).collect()]
    if many:
        ranks = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, bins)])
        found = x.agg(*[F.percentile_approx(f"c{j}", ranks, accuracy).alias(f"c{j}") for j in many]).first()
        held.update({j: found[f"c{j}"] for j in many})
    rows = []
    for j in range(k):
        v = np.unique(np.array(held.get(j, []), np.float32))
        rows.append((j, ((v[1:].astype(np.float64) + v[:-1]) / 2).astype(np.float32).tolist()))
    return spark.createDataFrame(rows, "feature int, cuts array<float>")


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """keep, codes: two bytes a feature, the bin of its value or, if it is missing, the number of bins."""
    sent = df.sparkSession.sparkContext.broadcast(cuts)  # at most MAX_BINS numbers a feature

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, len(features)), "<u2")
            for j, c in enumerate(sent.value):
                x = batch.column(len(keep) + j).to_numpy(zero_copy_only=False).astype(np.float32)
                codes[:, j] = np.where(np.isnan(x), len(c) + 1, np.searchsorted(c, x, side="right"))
            width = codes.shape[1] * 2
            blob = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1) * width).astype(np.int32)), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], blob], names=[*keep, "codes"])

    rows = df.select(*keep, *[F.col(f"`{c}`").cast("float").alias(f"_f{j}") for j, c in enumerate(features)])
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(coded, f"{fields}, codes binary")


# Growing -------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary rows of equal length as a matrix."""
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    size, offsets = np.dtype(kind).itemsize * width, np.frombuffer(column.buffers()[1], np.int32)
    first = int(offsets[column.offset])
    return flat[first : first + size * len(column)].view(kind).reshape(len(column), width)


def grow(table: DataFrame, cuts: list[np.ndarray], fits: list[Fit], folder: str, label: str = "y", features: tuple[str, ...] = (), staged: dict[int, DataFrame] | None = None) -> tuple[list[Forest], DataFrame]:
    """The fits' forests, and the table with margins (array<double>, one a fit). table: binned(), with label and what conditions name.

    staged: its keys get the same table after so many trees, or all of a fit that has fewer.
    """
    spark, k = table.sparkSession, len(cuts)
    widths = np.array([len(c) + 1 for c in cuts])
    wide = int(widths.max(initial=1)) + 1
    uses = [F.coalesce(F.expr(f.train), F.lit(False)) & F.col(label).isNotNull() for f in fits]
    counted = table.agg(*[F.sum(u.cast("long")).alias(f"n{i}") for i, u in enumerate(uses)], *[F.sum(F.when(u, F.col(label)).cast("long")).alias(f"p{i}") for i, u in enumerate(uses)]).first()
    bases = [float(np.clip(counted[f"p{i}"] / counted[f"n{i}"], 1e-6, 1 - 1e-6)) if counted[f"n{i}"] else 0.5 for i in range(len(fits))]
    start = F.array(*[F.lit(float(np.log(b / (1 - b)))) for b in bases])
    kept = [c for c in table.columns if c != "codes"]
    state = table.select(*kept, "codes", F.array(*uses).alias("_uses"), start.alias("margins"))
    forests: list[list[_Tree]] = [[] for _ in fits]
    pending: list[dict[int, tuple]] = []

    def context(batch: pa.RecordBatch, pending: list[dict[int, tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = _matrix(batch.column("codes"), "<u2", k)
        used = batch.column("_uses").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(fits))
        margins = batch.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(fits)).copy()
        for trees in pending:
            for i, tree in trees.items():
                margins[:, i] += tree[4][_leaves(tree, codes, widths)]
        return codes, used, margins

    def histograms(sent) -> DataFrame:
        """fit, node, feature, bin, g, h of the open nodes; feature -1 holds a node's whole sums."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pending, growing = sent.value
            sums = {i: np.zeros((2, len(open_), k * wide + 1), np.int64) for i, (_, open_) in growing.items()}
            for batch in batches:
                codes, used, margins = context(batch, pending)
                y = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
                for i, (tree, open_) in growing.items():
                    rows = np.flatnonzero(used[:, i])
                    slot = np.full(len(tree[0]), -1)
                    slot[open_] = np.arange(len(open_))
                    at = slot[_leaves(tree, codes[rows], widths)]
                    rows, at = rows[at >= 0], at[at >= 0]
                    own, n = codes[rows], len(open_)
                    for s, v in zip(sums[i], gradients(y[rows], margins[rows, i])):  # doubles hold a batch's sums exactly
                        s[:, -1] += np.bincount(at, v, n).astype(np.int64)
                        for j in range(k):
                            s[:, j * wide : (j + 1) * wide] += np.bincount(at * wide + own[:, j], v, n * wide).astype(np.int64).reshape(n, wide)
            for i, s in sums.items():
                node, cell = np.nonzero(s[1])
                feature, place = np.divmod(cell, wide)
                last = cell == k * wide
                columns = [np.full(len(node), i), growing[i][1][node], np.where(last, -1, feature), np.where(last, 0, place), s[0][node, cell], s[1][node, cell]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()] * 2)], names=["fit", "node", "feature", "bin", "g", "h"])

        cells = state.mapInArrow(summed, "fit int, node int, feature int, bin int, g long, h long")
        return cells.groupBy("fit", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))

    def chosen(cells: pd.DataFrame) -> pd.DataFrame:
        """The node's sums and best split, from at most features x bins cells."""
        whole = cells["feature"] == -1
        total_g, total_h = int(cells.loc[whole, "g"].sum()), int(cells.loc[whole, "h"].sum())
        g, h = np.zeros((k, wide), np.int64), np.zeros((k, wide), np.int64)
        at = cells.loc[~whole, "feature"].to_numpy(), cells.loc[~whole, "bin"].to_numpy()
        g[at], h[at] = cells.loc[~whole, "g"].to_numpy(), cells.loc[~whole, "h"].to_numpy()
        gone = np.arange(k), widths
        lost_g, lost_h = g[gone].copy(), h[gone].copy()
        g[gone] = h[gone] = 0
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        unit = 2.0**-POINT
        best = best_split(left_g * unit, left_h * unit, lost_g * unit, lost_h * unit, total_g * unit, total_h * unit, widths - 1, lost_h > 0) if k else None
        j, c, left = best or (-1, 0, True)
        lg, lh = (int(s[j, c]) + (int(gone[j]) if left else 0) for s, gone in ((left_g, lost_g), (left_h, lost_h))) if best else (0, 0)
        row = [int(cells["fit"].iat[0]), int(cells["node"].iat[0]), j, c, left, total_g, total_h, lg, lh]
        return pd.DataFrame([row], columns=["fit", "node", "feature", "bin", "missing_left", "g", "h", "left_g", "left_h"])

    for t in range(max((f.trees for f in fits), default=0)):
        growing = {i: _Tree() for i, f in enumerate(fits) if t < f.trees and counted[f"n{i}"]}
        open_ = {i: [tree.add(0, 0, 0)] for i, tree in growing.items()}
        for level in range(max(fits[i].depth for i in growing) + 1 if growing else 0):
            asked = {i: (growing[i].arrays(fits[i].rate), np.array([n.number for n in nodes])) for i, nodes in open_.items() if nodes and (level == 0 or level < fits[i].depth)}
            if not asked:
                break
            sent = spark.sparkContext.broadcast((pending, asked))
            found = histograms(sent).groupBy("fit", "node").applyInPandas(chosen, "fit int, node int, feature int, bin int, missing_left boolean, g long, h long, left_g long, left_h long")
            following: dict[int, list[_Node]] = {i: [] for i in growing}
            for r in sorted(found.collect(), key=lambda r: (r["fit"], r["node"])):  # a row a node
                tree, node = growing[r["fit"]], growing[r["fit"]].nodes[r["node"]]
                node.g, node.h = r["g"], r["h"]
                if r["feature"] >= 0 and level < fits[r["fit"]].depth:
                    node.feature, node.bin, node.missing_left = r["feature"], r["bin"], r["missing_left"]
                    node.children = (tree.add(level + 1, r["left_g"], r["left_h"]), tree.add(level + 1, r["g"] - r["left_g"], r["h"] - r["left_h"]))
                    following[r["fit"]] += node.children
            sent.unpersist()
            open_ = following
        for i, tree in growing.items():
            forests[i].append(tree)
        pending.append({i: tree.arrays(fits[i].rate) for i, tree in growing.items()})
        if len(pending) == KEPT or t + 1 == max(f.trees for f in fits) or t + 1 in (staged or ()):
            sent, fields = spark.sparkContext.broadcast(pending), [c for c in state.columns if c != "margins"]

            def moved(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = context(batch, sent.value)[2]
                    rows = pa.ListArray.from_arrays(np.arange(len(margins) + 1, dtype=np.int32) * len(fits), pa.array(margins.ravel()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in fields), rows], names=[*fields, "margins"])

            state = stored(state.select(*fields, "margins").mapInArrow(moved, state.select(*fields, "margins").schema), f"{folder}/margins-{t}")
            pending = []
            if t + 1 in (staged or ()):
                staged[t + 1] = state.drop("_uses", "codes")
    named = tuple(features) or tuple(f"x{j}" for j in range(k))
    out = [Forest(named, bases[i], tuple(_nodes(tree, cuts, fits[i].rate) for tree in trees)) for i, trees in enumerate(forests)]
    return out, state.drop("_uses", "codes")


def _nodes(tree: _Tree, cuts: list[np.ndarray], rate: float) -> tuple[tuple, ...]:
    """The tree's nodes numbered as fit_forest numbers them: depth first, right branches before left ones."""
    out: list[list] = [[]]
    todo = [(0, tree.nodes[0])]
    while todo:
        at, node = todo.pop()
        if node.children is None:
            out[at] = [-1, 0.0, -1, -1, -1, leaf_value(node.g, node.h, rate)]
            continue
        l, r = len(out), len(out) + 1
        cut = float(cuts[node.feature][node.bin]) if node.bin < len(cuts[node.feature]) else float(np.finfo(np.float32).max)
        out[at] = [node.feature, cut, l, r, l if node.missing_left else r, 0.0]
        out += [[], []]
        todo += [(l, node.children[0]), (r, node.children[1])]
    return tuple(map(tuple, out))


def fit(df: DataFrame, features: list[str], fits: list[Fit], folder: str, keep: list[str], label: str = "y", staged: dict[int, DataFrame] | None = None) -> tuple[list[Forest], DataFrame]:
    """Cuts, codes and forests of a table; the second result has keep, label and margins. No step collects rows. staged: see grow()."""
    found = cut_table(df, features)
    cuts = [np.array(r["cuts"], np.float32) for r in found.orderBy("feature").collect()]  # a row a feature
    table = stored(binned(df, features, cuts, [*keep, label]), f"{folder}/binned")
    return grow(table, cuts, fits, folder, label, tuple(features), staged)
