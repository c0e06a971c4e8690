"""Nested cross-validation of boosted trees: settings by inner folds, one held-out score a row, calibration, final fit."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrow.functions import scalar
from marrow.operators import boosting, calibrate, checks, conformal, forests, metrics, resample
from marrow.operators.storage import step_folder, stored

OUTER, INNER = 5, 3
SPEC = ["spec", "depth", "trees", "rate", "part"]
#: None: the search for settings uses all rows of an outer fold, unless train() is asked for fewer.
SEARCH_ROWS: int | None = None


@dataclass(frozen=True)
class Fitted:
    oof: DataFrame
    forest: boosting.Forest
    calibrator: calibrate.Calibrator | calibrate.KnotTable
    settings: tuple[int, int, float]


def _search_specs(inside: dict[int, np.ndarray], y: np.ndarray, grid, seed: int) -> tuple[pd.DataFrame, pd.DataFrame, list[tuple[np.ndarray, np.ndarray]]]:
    """A fit for each outer fold, setting and inner fold; inner folds deal the classes in turn. inside: an outer fold's training rows."""
    rows, keys, parts = [], [], []
    for k, inside in sorted(inside.items()):
        rng = np.random.default_rng([seed, int(k)])
        inner = np.empty(len(inside), int)
        order = np.lexsort((rng.random(len(inside)), y[inside]))
        inner[order] = np.arange(len(inside)) % INNER
        for c, (depth, trees, rate) in enumerate(grid):
            for j in range(INNER):
                rows.append((len(rows), depth, trees, rate, len(parts) + j))
                keys.append((len(keys), int(k), c))
        parts += [(inside[inner != j].astype(np.int32), inside[inner == j].astype(np.int32)) for j in range(INNER)]
    return pd.DataFrame(rows, columns=SPEC), pd.DataFrame(keys, columns=["spec", "fold", "combo"]), parts


def _chosen(table: pd.DataFrame, inside: dict[int, np.ndarray], spark: SparkSession, features: list[str], label: str, grid, seed: int) -> tuple[dict[int, tuple], tuple]:
    """Each outer fold's setting, and the one chosen most."""
    specs, keys, parts = _search_specs(inside, table[label].to_numpy(), grid, seed)
    # Written once: the metric reads the scores twice, and every fit would run again.
    scored = stored(boosting.fit_many(spark, table, features, specs, parts, label).where("position IS NOT NULL"), step_folder(spark, "search"))
    return _best(scored, keys, grid)


def _best(scored: DataFrame, keys: pd.DataFrame, grid) -> tuple[dict[int, tuple], tuple]:
    """Each outer fold's setting, and the one chosen most. scored: spec, y, p; keys: each spec's fold and setting."""
    spark = scored.sparkSession
    scores = metrics.auc(scored.select("spec", "y", "p"), ["spec"]).join(F.broadcast(spark.createDataFrame(keys)), "spec")
    chosen = resample.best_combination(scores.select("fold", "combo", F.col("auc").alias("score"))).cache()
    best = {r["fold"]: grid[r["combo"]] for r in chosen.collect()}  # a row a fold
    modal = grid[resample.modal_combination(chosen).first()["combo"]]
    chosen.unpersist()
    return best, modal


def _sampled(folded: DataFrame, features: list[str], label: str, key: str, grid, seed: int, most: int) -> tuple[dict[int, tuple], tuple]:
    """_chosen() from so many rows of each outer fold, where train() is asked for that."""
    rows = folded.select(key, label, "fold", *features)
    samples = [resample.stratified_subsample(rows.where(F.col("fold") != k), most, label, key, seed + k).withColumn("fold", F.lit(k)) for k in range(OUTER)]
    table = boosting.table_of(reduce(DataFrame.unionByName, samples), features, label, key, ["fold"])
    return _chosen(table, {k: np.flatnonzero(table["fold"].to_numpy() == k) for k in range(OUTER)}, folded.sparkSession, features, label, grid, seed)


def _grown(folded: DataFrame, features: list[str], label: str, key: str, grid, seed: int) -> tuple[dict[int, tuple], tuple]:
    """_chosen() for a table of any size and from all of its rows: every fit of the search is grown on Spark, all of them in step."""
    spark, rows = folded.sparkSession, folded.select(key, label, "fold", *features).withColumnRenamed("fold", "_outer")
    for k in range(OUTER):  # the rows of fold k are dealt as a class of their own, which no fit and no score of k uses
        own = rows.withColumn("_own", F.when(F.col("_outer") != k, F.col(label)))
        rows = resample.stratified_folds(own, INNER, "_own", key, seed + 1 + k).drop("_own").withColumnRenamed("fold", f"_inner{k}")
    shapes = list(dict.fromkeys((depth, rate) for depth, _, rate in grid))
    staged = dict.fromkeys(trees for _, trees, _ in grid)
    # Fewer trees of a shape are the first ones of the most.
    asked = [(k, depth, rate, j) for k in range(OUTER) for depth, rate in shapes for j in range(INNER)]
    fits = [forests.Fit(depth, max(n for d, n, r in grid if (d, r) == (depth, rate)), rate, f"_outer <> {k} AND _inner{k} <> {j}") for k, depth, rate, j in asked]
    kept = ["_outer", *(f"_inner{k}" for k in range(OUTER))]
    folder = step_folder(spark, "search")
    dealt = stored(rows.select(label, *kept, *[F.col(f"`{c}`").cast("float").alias(c) for c in features]), f"{folder}/dealt")  # the fits' cuts and codes read it again
    forests.fit(dealt, features, fits, folder, kept, label, staged)
    specs, scores = [], []
    for trees, margins in staged.items():
        held = []
        for place, (k, depth, rate, j) in enumerate(asked):
            if (depth, trees, rate) in grid:
                specs.append((len(specs), k, grid.index((depth, trees, rate))))
                mine = (F.col("_outer") != k) & (F.col(f"_inner{k}") == j)
                held.append(F.when(mine, F.struct(F.lit(specs[-1][0]).alias("spec"), F.get("margins", F.lit(place)).alias("z"))))
        cells = margins.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.explode(F.array_compact(F.array(*held))).alias("c"))
        scores.append(cells.select("c.spec", "y", scalar.sigmoid(F.col("c.z")).alias("p")))
    return _best(reduce(DataFrame.unionByName, scores), pd.DataFrame(specs, columns=["spec", "fold", "combo"]), grid)


def _small(folded: DataFrame, features: list[str], label: str, key: str, grid, seed: int, most: int | None) -> tuple[DataFrame, boosting.Forest, tuple]:
    """Held-out scores, the final forest and its setting; every fit, the final one too, is a task that has the table."""
    spark = folded.sparkSession
    table = boosting.table_of(folded, features, label, key, ["fold"])
    fold = table["fold"].to_numpy()
    inside = {k: np.flatnonzero(fold != k) for k in set(fold.tolist())}
    if most and any(len(own) > most for own in inside.values()):
        best, modal = _sampled(folded, features, label, key, grid, seed, most)
    else:
        best, modal = _chosen(table, inside, spark, features, label, grid, seed)
    folds = sorted(best)
    specs = pd.DataFrame([(int(k), *best[k], i) for i, k in enumerate(folds)] + [(-1, *modal, len(folds))], columns=SPEC)
    parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in folds] + [(np.arange(len(table)), np.arange(0))]
    fits = stored(boosting.fit_many(spark, table, features, specs, parts, label), step_folder(spark, "fits"))
    final = pickle.loads(fits.where("forest IS NOT NULL").first()["forest"])
    ids = spark.createDataFrame(pa.table({"position": pa.array(np.arange(len(table)), pa.int32()), key: pa.Array.from_pandas(table[key])}))
    held = fits.where("forest IS NULL").join(ids, "position").select(F.col(key).alias("row_id"), "y", "p", F.col("spec").cast("int").alias("fold"))
    return held, final, modal


def _large(folded: DataFrame, features: list[str], label: str, key: str, grid, seed: int, most: int | None) -> tuple[DataFrame, boosting.Forest, tuple]:
    """The same for a table of any size: all fits of the search grown together on Spark, then all folds' fits and the final one."""
    rows = folded.select(key, label, "fold", *features)
    best, modal = _sampled(folded, features, label, key, grid, seed, most) if most else _grown(folded, features, label, key, grid, seed)
    fits = [forests.Fit(*best[k], f"fold <> {k}") for k in range(OUTER)] + [forests.Fit(*modal)]
    grown, margins = forests.fit(rows, features, fits, step_folder(folded.sparkSession, "train"), [key, "fold"], label)
    p = scalar.sigmoid(F.get("margins", F.col("fold")))
    return margins.select(F.col(key).alias("row_id"), F.col(label).alias("y"), p.alias("p"), "fold"), grown[-1], modal


def train(df: DataFrame, features: list[str], label: str = "y", key: str = "row_id", grid=resample.GRID, seed: int = 42, search_rows: int | None = None) -> Fitted:
    """Fits hold the table in their tasks while it has at most boosting.MOST_ROWS rows, and are grown on Spark beyond.

    search_rows: settings are searched on so many rows of an outer fold, as the reference does for one of its datasets; else on all.
    """
    folded = resample.stratified_folds(df, OUTER, label, key, seed)
    fitted = _small if df.limit(boosting.MOST_ROWS + 1).count() <= boosting.MOST_ROWS else _large
    held, forest, modal = fitted(folded, features, label, key, grid, seed, search_rows or SEARCH_ROWS)
    held = held.cache()
    checks.assert_covered(folded.select(F.col(key).alias("row_id")), held)
    calibrator = calibrate.pick(held)
    return Fitted(calibrate.cross_fit(held, calibrator.method), forest, calibrator, modal)


def report(fitted: Fitted, alpha: float = 0.1, n_boot: int = 2000) -> dict:
    """The metrics of cross-fitted scores, all four with intervals, threshold and verdict shares."""
    scored = fitted.oof.select("y", F.col("p_cal").alias("p"))
    q = conformal.q_hat(scored, alpha).first()["q_hat"]
    bounds = {r["metric"]: [r["point"], r["lo"], r["hi"]] for r in metrics.bootstrap(scored, n_boot=n_boot).collect()}
    c = fitted.calibrator
    calibration = c.to_json() if isinstance(c, calibrate.Calibrator) else {"type": c.method, "knots": c.table.count()}
    shares = {r["verdict"]: r["fraction"] for r in conformal.verdict_fractions(conformal.verdicts(scored, q)).collect()}
    return {**metrics.evaluation(scored).first().asDict(), "intervals": bounds, "q_hat": q, "verdicts": shares, "calibration": calibration}


def predict(df: DataFrame, fitted: Fitted, q_hat: float) -> DataFrame:
    """df with p_raw, p_cal and verdict."""
    scored = calibrate.calibrated(boosting.score(df, fitted.forest, "p_raw"), fitted.calibrator, "p_raw")
    return conformal.verdicts(scored.withColumn("p", F.col("p_cal")), q_hat).drop("p")
