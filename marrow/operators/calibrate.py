"""Calibration: sigmoid and isotonic fits on cells, cross-fitting, and transfer by a fitted intercept.

A fit sees (p, pos, neg) cells summed by Spark. Newton fits need only a few sums a step, so each step is
one aggregate. The isotonic fit pools its cells by ranges of bounded size; neighbouring ranges are pooled together only
where the blocks at their border are out of order, until none is. Up to MOST_KNOTS its knots become one expression, more stay
a table that scores meet by an as-of join.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.functions import scalar
from marrow.operators import metrics
from marrow.operators.resample import stratified_split
from marrow.operators.storage import step_folder, stored

TOLERANCE, MOST_STEPS = 1e-10, 100
#: Blocks that a range of scores holds, which a task pools.
RANGE_BLOCKS = 100_000
#: Knots that a plan carries as constants.
MOST_KNOTS = 2_000
METHODS = ("sigmoid", "isotonic")


@dataclass(frozen=True)
class Calibrator:
    method: str
    a: float | None = None
    b: float | None = None
    x: tuple[float, ...] = ()
    y: tuple[float, ...] = ()

    def apply(self, p: Column) -> Column:
        if self.method == "sigmoid":
            return scalar.sigmoid_calibrated(p, self.a, self.b)
        return scalar.interpolate(p, F.array(*map(F.lit, self.x)), F.array(*map(F.lit, self.y)))

    def to_json(self) -> dict:
        return {"type": "sigmoid", "a": self.a, "b": self.b} if self.method == "sigmoid" else {"type": "isotonic", "x": list(self.x), "y": list(self.y)}

    @staticmethod
    def from_json(d: dict) -> "Calibrator":
        return Calibrator("sigmoid", a=d["a"], b=d["b"]) if d["type"] == "sigmoid" else Calibrator("isotonic", x=tuple(d["x"]), y=tuple(d["y"]))


def logistic_fit(scored: DataFrame, x: Column) -> tuple[float, float]:
    """(intercept, slope) of y on x without penalty; one aggregate a Newton step."""
    d = scored.select(F.col("y").cast("double").alias("y"), x.alias("x")).where("y IS NOT NULL AND x IS NOT NULL").groupBy("x").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).cache()
    w = np.zeros(2)
    try:
        for _ in range(MOST_STEPS):
            q = scalar.sigmoid(F.lit(float(w[0])) + F.lit(float(w[1])) * F.col("x"))
            v = F.col("n") * q * (1 - q)
            r = d.select(F.col("pos") - F.col("n") * q, v, "x").toDF("g", "v", "x").agg(F.sum("g"), F.sum(F.col("g") * F.col("x")), F.sum("v"), F.sum(F.col("v") * F.col("x")), F.sum(F.col("v") * F.col("x") * F.col("x"))).first()
            if r[0] is None:
                raise ValueError("no rows to fit")
            hessian = np.array([[r[2], r[3]], [r[3], r[4]]])
            if abs(np.linalg.det(hessian)) < 1e-18:
                break
            step = np.linalg.solve(hessian, np.array([r[0], r[1]]))
            w = w + np.clip(step, -10, 10)
            if np.abs(step).max() < TOLERANCE:
                break
    finally:
        d.unpersist()
    return float(w[0]), float(w[1])


def fit_sigmoid(scored: DataFrame) -> Calibrator:
    intercept, slope = logistic_fit(scored, F.col("p"))
    return Calibrator("sigmoid", a=-slope, b=-intercept)


def pool_adjacent(x0: np.ndarray, x1: np.ndarray, pos: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Pools neighbours until pos / n rises; blocks keep their first and last x."""
    out: list[list[float]] = []
    for block in zip(x0.tolist(), x1.tolist(), pos.tolist(), n.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            a, b = out[-2], out.pop()
            out[-1] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
    return pd.DataFrame(out, columns=["x0", "x1", "pos", "n"]).astype("float64")


def _cut_into(edges: np.ndarray, column: str, spark) -> Column:
    """The number of edges that are not above the column's value."""
    sent = spark.sparkContext.broadcast(edges)  # an edge a range

    @F.pandas_udf("long")
    def at(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sent.value, x.to_numpy(), side="right").astype(np.int64))

    return at(column)


def _edges(df: DataFrame, column: str, each: int) -> np.ndarray:
    """Values between which about so many rows lie."""
    n = -(-df.count() // each)
    if n < 2:
        return np.zeros(0)
    return np.unique(df.agg(F.percentile_approx(column, F.array(*[F.lit(i / n) for i in range(1, n)]), max(10_000, 10 * n)).alias("e")).first()["e"])


def isotonic_blocks(scored: DataFrame, each: int = RANGE_BLOCKS) -> DataFrame:
    """r, x0, x1, pos, n: the blocks of the isotonic fit, by range and x0.

    Ranges are pooled each by itself. Then, round by round, pairs of neighbouring ranges whose border is out of order are
    pooled together and cut anew, which leaves at least one block less; a range never holds more than twice ``each`` blocks.
    The driver sees a row a range.
    """
    spark, folder = scored.sparkSession, step_folder(scored.sparkSession, "isotonic")
    cells = metrics.cells(scored).select(F.col("p").cast("double").alias("x0"), F.col("p").cast("double").alias("x1"), F.col("pos").cast("double").alias("pos"), (F.col("pos") + F.col("neg")).cast("double").alias("n"))
    cells = stored(cells, f"{folder}/cells")
    fields = "r long, x0 double, x1 double, pos double, n double"
    edges = _edges(cells, "x0", each)

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x0")
        out = pool_adjacent(*(pdf[c].to_numpy() for c in ("x0", "x1", "pos", "n")))
        own = np.sort(pdf["r"].unique())
        # The blocks are dealt to the pair's ranges again; one that is left without has none any more.
        out.insert(0, "r", own[np.arange(len(out)) * len(own) // len(out)])
        return out

    blocks = stored(cells.withColumn("r", _cut_into(edges, "x0", spark) if len(edges) else F.lit(0).cast("long")).groupBy("r").applyInPandas(pooled, fields), f"{folder}/0")
    for step in itertools.count(1):
        first, last = (F.expr(f"{f}_by(struct(pos, n), x0)") for f in ("min", "max"))
        ends = sorted(blocks.groupBy("r").agg(first.alias("f"), last.alias("l")).collect(), key=lambda e: e["r"])
        pairs, at = {}, 0
        while at + 1 < len(ends):
            a, b = ends[at]["l"], ends[at + 1]["f"]
            if a["pos"] * b["n"] >= b["pos"] * a["n"]:
                pairs[ends[at + 1]["r"]] = ends[at]["r"]
                at += 1
            at += 1
        if not pairs:
            return blocks
        met = list(pairs) + list(pairs.values())
        named = spark.createDataFrame([(r, pairs.get(r, r)) for r in met], "r long, pair long")
        held = blocks.join(F.broadcast(named), "r", "left")  # a row a range
        again = held.where("pair IS NOT NULL").groupBy("pair").applyInPandas(lambda pdf: pooled(pdf), fields)
        blocks = stored(held.where("pair IS NULL").select("r", "x0", "x1", "pos", "n").unionByName(again), f"{folder}/{step}")


def knots(blocks: DataFrame) -> DataFrame:
    """x, y: both ends of every block at its mean."""
    return blocks.select(F.explode(F.array_distinct(F.array("x0", "x1"))).alias("x"), (F.col("pos") / F.col("n")).alias("y"))


@dataclass(frozen=True)
class KnotTable:
    """An isotonic calibrator whose knots (x, y) are a table of any size."""

    table: DataFrame
    method: str = "isotonic"

    def to_json(self) -> dict:
        """Every knot; only a bundle, which is one document, asks for them."""
        rows = self.table.orderBy("x").collect()
        return {"type": "isotonic", "x": [r["x"] for r in rows], "y": [r["y"] for r in rows]}


def fit_isotonic(scored: DataFrame, most_knots: int = MOST_KNOTS) -> "Calibrator | KnotTable":
    """Isotonic least squares of y on p."""
    found = knots(isotonic_blocks(scored))
    few = found.orderBy("x").limit(most_knots + 1).collect()
    if not few:
        raise ValueError("no rows to fit")
    return KnotTable(found) if len(few) > most_knots else Calibrator("isotonic", x=tuple(r["x"] for r in few), y=tuple(r["y"] for r in few))


def interpolated(df: DataFrame, table: DataFrame, source: str = "p", name: str = "p_cal", each: int = RANGE_BLOCKS) -> DataFrame:
    """df with the piecewise linear function through the table's knots at source, constant beyond both ends.

    Each distinct score meets the knots around it once: scores and knots are cut into ranges of bounded size, windows run
    within a range, and the knots next to a range come from one row a range. Rows then take their score's value.
    """
    spark, folder = df.sparkSession, step_folder(df.sparkSession, "knots")
    asked = df.where(F.col(source).isNotNull()).select(F.col(source).cast("double").alias("x")).distinct().select("x", F.lit(None).cast("double").alias("y"))
    both = stored(asked.unionByName(table.select("x", "y")), f"{folder}/both")
    edges = _edges(both, "x", each)
    both = both.withColumn("r", _cut_into(edges, "x", spark) if len(edges) else F.lit(0).cast("long"))
    knot = F.when(F.col("y").isNotNull(), F.struct("x", "y"))
    ends = both.where("y IS NOT NULL").groupBy("r").agg(F.min(F.struct("x", "y")).alias("f"), F.max(F.struct("x", "y")).alias("l"))
    ranges = spark.range(len(edges) + 1).select(F.col("id").alias("r")).join(ends, "r", "left")
    # One row a range.
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    around = ranges.select("r", F.last("l", ignorenulls=True).over(before).alias("_before"), F.first("f", ignorenulls=True).over(after).alias("_after"))
    upto = Window.partitionBy("r").orderBy("x", F.col("y").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("r").orderBy(F.desc("x"), F.col("y").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_lo", F.last(knot, ignorenulls=True).over(upto)).withColumn("_hi", F.last(knot, ignorenulls=True).over(since)).where("y IS NULL").join(around, "r")
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    inner = F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"]) * (F.col("x") - lo["x"]) + lo["y"]
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (lo["x"] == F.col("x")), lo["y"]).otherwise(inner)
    found = placed.select(F.col("x").alias("_x"), value.alias(name))
    return df.join(found, F.col(source).cast("double") == F.col("_x"), "left").drop("_x")


def calibrated(df: DataFrame, calibrator: "Calibrator | KnotTable", source: str = "p", name: str = "p_cal") -> DataFrame:
    """df with source calibrated, by an expression or by an as-of join with the knots."""
    if isinstance(calibrator, Calibrator):
        return df.withColumn(name, calibrator.apply(F.col(source)))
    target = name if name != source else "_calibrated"
    out = interpolated(df, calibrator.table, source, target)
    return out if name != source else out.withColumn(source, F.col(target)).drop(target)


def fit(scored: DataFrame, method: str) -> Calibrator | KnotTable:
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}")
    return fit_sigmoid(scored) if method == "sigmoid" else fit_isotonic(scored)


def pick(scored: DataFrame) -> Calibrator | KnotTable:
    """The fit with the smaller in-sample calibration error; a tie goes to the sigmoid."""
    fits = [fit(scored, m) for m in METHODS]
    errors = [metrics.ece(calibrated(scored.select("y", "p"), c, "p", "p")).first()["ece"] for c in fits]
    return fits[int(errors[1] < errors[0])]


def cross_fit(oof: DataFrame, method: str) -> DataFrame:
    """Adds p_cal: each fold is scored by a fit on the other folds. oof: row_id, y, p, fold."""
    folds = [r["fold"] for r in oof.select("fold").distinct().orderBy("fold").collect()]  # a handful
    fits = {k: fit(oof.where(F.col("fold") != k), method) for k in folds}
    if any(isinstance(c, KnotTable) for c in fits.values()):
        return reduce(DataFrame.unionByName, [calibrated(oof.where(F.col("fold") == k), c) for k, c in fits.items()])
    out = F.lit(None).cast("double")
    for k, c in fits.items():
        out = F.when(F.col("fold") == k, c.apply(F.col("p"))).otherwise(out)
    return oof.withColumn("p_cal", out)


def calibration_in_the_large(scored: DataFrame) -> tuple[float, float]:
    """(intercept, slope) of y on the log-odds of p."""
    return logistic_fit(scored, scalar.logit(F.col("p")))


def fit_intercept(scored: DataFrame) -> float:
    """c of sigmoid(logit(p) + c): one sum of residuals and weights a Newton step."""
    d, c = scored.select("y", scalar.logit(F.col("p")).alias("z")).cache(), 0.0
    try:
        for _ in range(MOST_STEPS):
            q = scalar.sigmoid(F.col("z") + F.lit(c))
            g, h = d.agg(F.sum(F.col("y") - q), F.sum(q * (1 - q))).first()
            if h is None or h < 1e-12:
                break
            c += g / h
            if abs(g / h) < TOLERANCE:
                break
    finally:
        d.unpersist()
    return float(c)


def shift(p: Column, c: float) -> Column:
    return scalar.sigmoid(scalar.logit(p) + F.lit(float(c)))


def fit_intercepts(scored: DataFrame, key: str) -> dict:
    """fit_intercept for every value of key at once: one grouped aggregate a Newton step."""
    d = scored.where(F.col("y").isNotNull() & F.col("p").isNotNull()).groupBy(F.col(key).alias("k"), scalar.logit(F.col("p")).alias("z")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).cache()
    fitted, open_keys = {r["k"]: 0.0 for r in d.select("k").distinct().collect()}, True
    try:
        for _ in range(MOST_STEPS):
            at = _lookup(F.col("k"), fitted)
            q = scalar.sigmoid(F.col("z") + at)
            open_keys = False
            for r in d.groupBy("k").agg(F.sum(F.col("pos") - F.col("n") * q).alias("g"), F.sum(F.col("n") * q * (1 - q)).alias("h")).collect():  # a row a key
                if r["h"] >= 1e-12 and abs(r["g"] / r["h"]) >= TOLERANCE:
                    fitted[r["k"]] += r["g"] / r["h"]
                    open_keys = True
            if not open_keys:
                break
    finally:
        d.unpersist()
    return fitted


def fit_lines(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, calibration_intercept, calibration_slope: the logistic fit of y on the log-odds of p, for every combination of keys at once.

    One grouped aggregate a Newton step over distinct scores. NULL where a combination has one score or one class only.
    """
    spark = scored.sparkSession
    d = scored.where(F.col("y").isNotNull() & F.col("p").isNotNull()).groupBy(*keys, scalar.logit(F.col("p")).alias("z")).agg(F.sum("y").cast("double").alias("pos"), F.count(F.lit(1)).alias("n")).cache()
    types = ", ".join(f"`{k}` {scored.schema[k].dataType.simpleString()}" for k in keys) + ", calibration_intercept double, calibration_slope double"
    try:
        heads = d.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), (F.min("z") < F.max("z")).alias("wide")).collect()  # a row a combination
        lines = {tuple(r[k] for k in keys): np.zeros(2) if r["wide"] and 0 < r["pos"] < r["n"] else None for r in heads}
        for _ in range(MOST_STEPS):
            at = spark.createDataFrame([(*g, float(w[0]), float(w[1])) for g, w in lines.items() if w is not None], types)
            q = scalar.sigmoid(F.col("calibration_intercept") + F.col("calibration_slope") * F.col("z"))
            same = reduce(lambda c, k: c & d[k].eqNullSafe(at[k]), keys, F.lit(True))
            v, g = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
            sums = d.join(F.broadcast(at), same).select(*[d[k] for k in keys], g.alias("g"), v.alias("v"), "z").groupBy(*keys).agg(F.sum("g"), F.sum(F.col("g") * F.col("z")), F.sum("v"), F.sum(F.col("v") * F.col("z")), F.sum(F.col("v") * F.col("z") * F.col("z")))
            moved = False
            for r in sums.collect():
                group, (g0, g1, h0, h1, h2) = tuple(r[: len(keys)]), r[len(keys) :]
                if abs(h0 * h2 - h1 * h1) >= 1e-18:
                    step = np.linalg.solve(np.array([[h0, h1], [h1, h2]]), np.array([g0, g1]))
                    lines[group] = lines[group] + np.clip(step, -10, 10)
                    moved |= bool(np.abs(step).max() >= TOLERANCE)
            if not moved:
                break
    finally:
        d.unpersist()
    return spark.createDataFrame([(*g, *(map(float, w) if w is not None else (None, None))) for g, w in lines.items()], types)


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(key.eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(out)
    return out


def transfer_study(scored: DataFrame, site: str, home: str, share: float = 0.3, seed: int = 42, n_boot: int = 0) -> DataFrame:
    """site, block, n, auc, brier, ece, intercept, calibration_intercept, calibration_slope: for each other site all rows as they are, its evaluation rows as
    they are, and the same rows after an intercept fitted on its calibration rows. scored: row_id, y, p, site.

    With n_boot also pr_auc, and for every metric its bounds over so many resamples, as auc_lo, auc_hi and so on. All
    sites go through every step together.
    """
    other = scored.where((F.col(site) != home) & F.col(site).isNotNull()).select("row_id", "y", "p", F.col(site).alias("site"))
    split = stratified_split(other.withColumn("_class", F.concat_ws("|", "site", "y")), share, "_class", seed=seed).drop("_class").cache()
    try:
        fitted = fit_intercepts(split.where("part = 'calibration'"), "site")
        moved = scalar.sigmoid(scalar.logit(F.col("p")) + _lookup(F.col("site"), fitted))
        held = F.col("part") == "evaluation"
        blocks = F.array(F.struct(F.lit("naive_all_rows").alias("block"), F.col("p").alias("p")), F.when(held, F.struct(F.lit("naive").alias("block"), F.col("p").alias("p"))), F.when(held, F.struct(F.lit("recalibrated").alias("block"), moved.alias("p"))))
        rows = split.select("site", "y", F.explode(blocks).alias("b")).where("b IS NOT NULL").select("site", "b.block", "y", "b.p")
        out = metrics.evaluation_by(rows, ["site", "block"]).withColumn("intercept", _lookup(F.col("site"), fitted))
        out = out.join(F.broadcast(fit_lines(rows, ["site", "block"])), ["site", "block"])
        if n_boot:
            bounds = metrics.bootstrap(rows, ["site", "block"], n_boot, seed)
            shown = {"roc_auc": "auc", "pr_auc": "pr_auc", "brier": "brier", "ece": "ece"}
            of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
            named = [of(m, c).alias(f"{name}_{c}") for m, name in shown.items() for c in ("lo", "hi")]
            out = out.join(F.broadcast(bounds.groupBy("site", "block").agg(of("pr_auc", "point").alias("pr_auc"), *named)), ["site", "block"])
        # A row for each site and block.
        return scored.sparkSession.createDataFrame(out.collect(), out.schema)
    finally:
        split.unpersist()
