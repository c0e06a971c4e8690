"""Gradient-boosted trees with learned directions for missing values, and three ways to score them.

Many fits of a bounded table (folds x settings) run as one Spark job: a row of a spec table is a fit, and
the features are sent to every task once. Larger tables are grown level by level on Spark, in ``forests``. Scoring is distributed over rows: Arrow batches walk all
trees level by level; small forests can also be one SQL expression.

A node is (f, t, l, r, m, v): a row goes left if its feature, rounded to single precision, is below t; a
missing one goes to m; a leaf has f = -1 and adds v. Trees are summed in order, in doubles.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions import scalar

#: Rows of a table that fits may hold in a task; larger ones are grown on Spark (see forests).
MOST_ROWS = 1_000_000
MAX_BINS = 256
#: Gradients are counted in units of 2**-POINT; sums of 2**33 rows fit 64 bits, those of MOST_ROWS fit a double's 53.
POINT = 30
LAMBDA, MIN_CHILD = 1.0, 1.0


@dataclass(frozen=True)
class Forest:
    features: tuple[str, ...]
    base: float
    trees: tuple[tuple[tuple, ...], ...]


def _bins(x: np.ndarray) -> list[np.ndarray]:
    """Ascending cut points of each feature: midpoints of neighbouring values, or quantiles of many."""
    out = []
    for j in range(x.shape[1]):
        v = np.unique(x[~np.isnan(x[:, j]), j])
        if len(v) > MAX_BINS:
            v = np.unique(np.quantile(v, np.linspace(0, 1, MAX_BINS)).astype(np.float32))
        out.append(((v[1:].astype(np.float64) + v[:-1]) / 2).astype(np.float32))
    return out


def best_split(left_g, left_h, lost_g, lost_h, total_g: float, total_h: float, last: np.ndarray, has_lost: np.ndarray, both: bool = True) -> tuple[int, int, bool] | None:
    """feature, bin, whether missing values go left: the split of largest gain, None if none gains.

    left_g, left_h: sums up to each bin, by feature; lost_g, lost_h: those of missing values; last: features' last bins. Without
    both, missing values only go left, as where there are none.
    """
    place = np.arange(left_g.shape[1])[None, :]
    # A cut after the last bin has all present values on the left and the missing ones on the right.
    valid = (place < last[:, None]) | ((place == last[:, None]) & has_lost[:, None])
    lg, lh = (np.stack([v + gone[:, None], v], axis=1) if both else v[:, None, :] for v, gone in ((left_g, lost_g), (left_h, lost_h)))
    rg, rh = total_g - lg, total_h - lh
    gain = np.where(valid[:, None, :] & (lh >= MIN_CHILD) & (rh >= MIN_CHILD), lg**2 / (lh + LAMBDA) + rg**2 / (rh + LAMBDA) - total_g**2 / (total_h + LAMBDA), -np.inf)
    j, right, c = np.unravel_index(gain.argmax(), gain.shape)
    return (int(j), int(c), not right) if gain[j, right, c] > 1e-12 else None


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Each feature's bins in a row of their own; a missing value has the feature's number of bins."""
    out = np.zeros((len(cuts), len(x)), np.uint16)
    for j, c in enumerate(cuts):
        out[j] = np.where(np.isnan(x[:, j]), len(c) + 1, np.searchsorted(c, x[:, j], side="right"))
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss in units of 2**-POINT, whole numbers."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * 2**POINT), np.rint(p * (1 - p) * 2**POINT)


def _histogram(codes: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, wide: int) -> np.ndarray:
    """Sums of g and h by feature and bin over the rows."""
    out = np.zeros((2, len(codes), wide))
    g, h = g[rows], h[rows]
    for j, own in enumerate(codes):
        place = own[rows].astype(np.intp)
        out[0, j], out[1, j] = np.bincount(place, g, wide), np.bincount(place, h, wide)
    return out


def fit_forest(x: np.ndarray, y: np.ndarray, depth: int, trees: int, rate: float, features: tuple[str, ...] = ()) -> Forest:
    """Second-order boosting of the logistic loss over histograms. Missing values are NaN; both directions are tried.

    Of two children only the smaller one is counted, and the other is what it leaves of its parent: doubles hold sums of whole
    numbers exactly (2**23 rows), so this changes no sum.
    """
    x = np.asarray(x, np.float32)
    n, k = x.shape
    cuts = _bins(x)
    codes = _codes(x, cuts)
    any_lost = bool(np.isnan(x).any())
    del x  # the largest array; fit_many() holds no other reference to it
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    margin = np.full(n, np.log(base / (1 - base)))
    widths = np.array([len(c) + 1 for c in cuts], int)
    wide = int(widths.max(initial=1)) + 1
    last, gone, every, unit = widths - 1, (np.arange(k), widths), np.arange(n), 2.0**-POINT
    out = []
    for _ in range(trees):
        g, h = gradients(y, margin)
        nodes: list[list] = [[-1, 0.0, -1, -1, -1, 0.0]]
        front = [(0, every, 0, g.sum(), h.sum(), _histogram(codes, every, g, h, wide) if depth and k else None)]
        while front:
            at, rows, level, total_g, total_h, sums = front.pop()
            best = None
            if sums is not None:
                lost = sums[:, *gone]
                left = np.cumsum(sums, axis=2)[:, :, :-1]
                if any_lost:  # from a feature's last bin on, its sums are those of all values that are there
                    left = np.where(np.arange(wide - 1) < widths[:, None], left, left[:, np.arange(k), last][:, :, None])
                best = best_split(left[0] * unit, left[1] * unit, lost[0] * unit, lost[1] * unit, total_g * unit, total_h * unit, last, lost[1] > 0, any_lost)
            if best is None:
                nodes[at][5] = float(np.float32(-rate * (total_g * unit) / (total_h * unit + LAMBDA)))
                margin[rows] += nodes[at][5]
                continue
            j, c, missing_left = best
            cut = float(cuts[j][c]) if c < len(cuts[j]) else float(np.finfo(np.float32).max)
            own = codes[j][rows]
            goes = np.where(own == widths[j], missing_left, own <= c)
            parts = rows[goes], rows[~goes]
            left_g, left_h = (s[j, c] + (gone_[j] if missing_left else 0) for s, gone_ in zip(left, lost))
            counted: list[np.ndarray | None] = [None, None]
            if level + 1 < depth:
                small = int(len(parts[1]) < len(parts[0]))
                counted[small] = _histogram(codes, parts[small], g, h, wide)
                counted[1 - small] = sums - counted[small]
            l, r = len(nodes), len(nodes) + 1
            nodes[at] = [j, cut, l, r, l if missing_left else r, 0.0]
            nodes += [[-1, 0.0, -1, -1, -1, 0.0], [-1, 0.0, -1, -1, -1, 0.0]]
            front += [(l, parts[0], level + 1, left_g, left_h, counted[0]), (r, parts[1], level + 1, total_g - left_g, total_h - left_h, counted[1])]
        out.append(tuple(map(tuple, nodes)))
    return Forest(tuple(features) or tuple(f"x{j}" for j in range(k)), base, tuple(out))


def margins(forest: Forest, x: np.ndarray) -> np.ndarray:
    """All rows step down each tree together, one level at a time."""
    return staged_margins(forest, x, [len(forest.trees)])[len(forest.trees)]


def staged_margins(forest: Forest, x: np.ndarray, stops: list[int]) -> dict[int, np.ndarray]:
    """The margins after each of so many trees."""
    x = np.asarray(x, np.float32)
    z = np.full(len(x), np.log(forest.base / (1 - forest.base)))
    every, out = np.arange(len(x)), {0: z.copy()} if 0 in stops else {}
    for n, tree in enumerate(forest.trees, 1):
        f, l, r, m = (np.array([node[i] for node in tree]) for i in (0, 2, 3, 4))
        t, v = np.array([node[1] for node in tree], np.float32), np.array([node[5] for node in tree])
        at = np.zeros(len(x), int)
        while (f[at] >= 0).any():
            inner = f[at] >= 0
            value = x[every, np.maximum(f[at], 0)]
            step = np.where(np.isnan(value), m[at], np.where(value < t[at], l[at], r[at]))
            at = np.where(inner, step, at)
        z += v[at]
        if n in stops:
            out[n] = z.copy()
    return out


def walk(forest: Forest, row: list[float | None]) -> float:
    """The margin of one row, node by node."""
    if len(row) != len(forest.features):
        raise ValueError(f"expected {len(forest.features)} values, got {len(row)}")
    z = float(np.log(forest.base / (1 - forest.base)))
    for tree in forest.trees:
        f, t, l, r, m, v = tree[0]
        while f >= 0:
            x = row[f]
            at = m if x is None or x != x else l if np.float32(x) < np.float32(t) else r
            f, t, l, r, m, v = tree[at]
        z += v
    return z


def score(df: DataFrame, forest: Forest, name: str = "p_raw") -> DataFrame:
    """df with the forest's probability, by Arrow batches."""
    held = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-margins(held.value, columns.to_numpy(dtype=np.float64, na_value=np.nan)))))

    return df.withColumn(name, scored(F.struct(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(forest.features)])))


def tree_sql(tree: tuple[tuple, ...], features: tuple[str, ...], at: int = 0) -> str:
    f, t, l, r, m, v = tree[at]
    if f < 0:
        return f"CAST({v!r} AS DOUBLE)"
    left, right = tree_sql(tree, features, l), tree_sql(tree, features, r)
    return f"CASE WHEN {features[f]} IS NULL THEN {left if m == l else right} WHEN CAST({features[f]} AS FLOAT) < CAST({t!r} AS FLOAT) THEN {left} ELSE {right} END"


def forest_sql(forest: Forest, most_nodes: int = 2_000) -> str:
    """The margin as one SQL expression that Spark and other engines read alike; large forests are refused."""
    if sum(map(len, forest.trees)) > most_nodes:
        raise ValueError("the forest is too large for one expression")
    start = float(np.log(forest.base / (1 - forest.base)))
    return " + ".join([f"CAST({start!r} AS DOUBLE)", *[f"({tree_sql(t, forest.features)})" for t in forest.trees]])


def score_native(df: DataFrame, forest: Forest, name: str = "p_raw") -> DataFrame:
    return df.withColumn(name, scalar.sigmoid(F.expr(forest_sql(forest))))


def table_of(df: DataFrame, features: list[str], label: str = "y", key: str = "row_id", extra: list[str] = ()) -> pd.DataFrame:
    """The training table on the driver, in key order; its size is checked first."""
    rows = df.select(key, label, *extra, *[F.col(c).cast("float") for c in features])
    if rows.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; grow them with forests.fit")
    return rows.toArrow().to_pandas(self_destruct=True).sort_values(key)


def fit_many(spark: SparkSession, table: pd.DataFrame, features: list[str], specs: pd.DataFrame, parts: list[tuple[np.ndarray, np.ndarray]], label: str = "y") -> DataFrame:
    """A row for each spec and held-out row: position, y, p; a spec that holds out none has a row with its pickled forest.

    specs: spec, depth, trees, rate, part; parts: positions of training and held-out rows. Specs that differ in their number of trees alone
    are one fit, as the fewer trees are its first ones. A task is one fit, the longest first.
    """
    alike = [list(own.itertuples()) for _, own in specs.groupby(["part", "depth", "rate"], sort=False)]
    order = sorted(alike, key=lambda own: -own[0].depth * max(s.trees for s in own))
    order = [[(s.spec, s.trees) for s in own] + [(own[0].depth, own[0].rate, own[0].part)] for own in order]
    held = spark.sparkContext.broadcast((table[features].to_numpy(np.float32), table[label].to_numpy(float), order, parts))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y, order, parts = held.value
        for batch in batches:
            for *own, (depth, rate, part) in (order[i] for i in batch["id"].tolist()):
                train, test = parts[part]
                forest = fit_forest(x[train], y[train], depth, max(n for _, n in own), rate, tuple(features))
                z = staged_margins(forest, x[test], [n for _, n in own])
                for spec, n in own:
                    out = pd.DataFrame({"spec": spec, "position": test, "y": y[test].astype(int), "p": 1 / (1 + np.exp(-z[n])), "forest": None})
                    yield out if len(test) else pd.DataFrame([(spec, None, None, None, pickle.dumps(replace(forest, trees=forest.trees[:n])))], columns=out.columns)

    return spark.range(0, len(order), 1, max(1, len(order))).mapInPandas(fitted, "spec int, position int, y int, p double, forest binary")
