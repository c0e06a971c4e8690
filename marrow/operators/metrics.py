"""Metrics of scored rows (y 0/1, p 0..1), all from one table of distinct scores.

``cells`` collapses rows to (p, pos, neg), which combines on the map side; every metric below is a sum
over cells. Where cells must be met in order of p, running sums are taken in two steps: within buckets of
p and over the buckets. So no window holds more than one bucket's cells, or one row a bucket. Buckets are as narrow
as scores are near 0 or 1: each octave of p, and of 1 - p, has BUCKETS of them, so rare events' scores spread too.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 10
#: For each octave of p below a half, and of 1 - p; octaves below 2 ** -OCTAVES share one set.
BUCKETS = 1024
OCTAVES = 64
#: Decision thresholds, 0.01 to 0.99.
THRESHOLDS = tuple(0.01 + i * ((0.99 - 0.01) / 98) for i in range(99))


def cells(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, p, pos, neg; rows with a missing label or score are left out."""
    used = scored.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    return used.groupBy(*keys, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))


def score_bucket(p: Column) -> Column:
    """A bucket that never falls as p grows from 0 to 1; beyond them p counts as 0 or 1."""
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))

    def octaves(x: Column) -> Column:
        # Where the logarithm is rounded up to a whole number, the step below is minus one: the octave before ends there.
        octave = F.floor(F.log2(F.greatest(x, F.lit(2.0**-OCTAVES))))
        return (octave + OCTAVES) * BUCKETS + F.floor((x / F.pow(F.lit(2.0), octave) - 1) * BUCKETS)

    return F.when(p <= 0.5, octaves(p)).otherwise(2 * OCTAVES * BUCKETS - octaves(1 - p))


def _below(cells: DataFrame, keys: list[str], bucket: Column | None = None) -> DataFrame:
    """Adds pos_below and neg_below, the sums over cells of smaller p with equal keys."""
    bucket = score_bucket(F.col("p")) if bucket is None else bucket
    df = cells.withColumn("_b", bucket)
    sums = df.groupBy(*keys, "_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    # Without keys the window below holds one row a bucket.
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_at"), F.coalesce(F.sum("_pos").over(over), F.lit(0)).alias("_opos"), F.coalesce(F.sum("_neg").over(over), F.lit(0)).alias("_oneg"))
    within = Window.partitionBy(*keys, "_b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.col("_b") == F.col("_at"))
    out = df.withColumn("_ip", F.coalesce(F.sum("pos").over(within), F.lit(0))).withColumn("_in", F.coalesce(F.sum("neg").over(within), F.lit(0))).join(offsets, same)
    return out.select(*[df[k] for k in keys], "p", "pos", "neg", (F.col("_opos") + F.col("_ip")).alias("pos_below"), (F.col("_oneg") + F.col("_in")).alias("neg_below"))


def auc(scored: DataFrame, keys: list[str] = (), bucket: Column | None = None) -> DataFrame:
    """keys, auc: the chance that a positive scores above a negative, ties counting half; NULL with one class."""
    keys = list(keys)
    ordered = _below(cells(scored, keys), keys, bucket)
    wins = F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg")))
    return ordered.groupBy(*keys).agg(F.try_divide(wins.cast("double"), 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """ap: precision at each distinct score, weighted by the recall it adds; no interpolation."""
    found = cells(scored)
    totals = found.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    joined = _below(found, []).crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    return joined.agg(F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * tp / (tp + fp)).alias("ap"))


def brier(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


def bin_edges(spark, bins: int = BINS) -> DataFrame:
    """bin, lo, hi, last; edges are i * (1 / bins) in doubles."""
    return spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") * F.lit(1.0 / bins)).alias("lo"), F.when(F.col("id") == bins - 1, 1.0).otherwise((F.col("id") + 1) * F.lit(1.0 / bins)).alias("hi"), (F.col("id") == bins - 1).alias("last"))


def bin_of(p: Column, bins: int = BINS) -> Column:
    """The bin whose half-open range holds p; the last one is closed. Edges are compared, never multiplied out."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.when((p < 0) | (p > 1), None).otherwise(F.size(F.filter(edges, lambda e: e <= p)))


def reliability_bins(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """bin, lo, hi, n, mean_p, frac_pos for every bin, the empty ones included."""
    sums = scored.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("frac_pos"))
    return bin_edges(scored.sparkSession, bins).join(sums, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_p", "frac_pos")


def ece(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Mean gap between score and outcome over the bins, weighted by their rows; 0 for no rows."""
    r = reliability_bins(scored, bins)
    return r.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frac_pos"))), F.sum("n").cast("double")), F.lit(0.0)).alias("ece"))


def evaluation(scored: DataFrame) -> DataFrame:
    """One row: n, positives, prevalence, auc, ap, brier, ece."""
    head = scored.agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("y").alias("prevalence"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return head.crossJoin(auc(scored)).crossJoin(average_precision(scored)).crossJoin(ece(scored))  # one row each


def evaluation_by(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, auc, brier, ece: one row for each combination of keys without NULL."""
    head = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    binned = scored.groupBy(*keys, bin_of(F.col("p")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("p").alias("mp"), F.avg("y").alias("fy"))
    gaps = binned.groupBy(*keys).agg((F.sum(F.col("k") * F.abs(F.col("mp") - F.col("fy"))) / F.sum("k")).alias("ece"))
    return head.join(auc(scored, keys), keys).join(gaps, keys).select(*keys, "n", "auc", "brier", "ece")


def net_benefit(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, model, treat_all, treat_none. Rows are summed by threshold bucket once, not met with every threshold."""
    if any(not 0 < t < 1 for t in thresholds):
        raise ValueError("thresholds must lie in (0, 1)")
    grid = sorted(thresholds)
    passed = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))
    sums = scored.groupBy(passed.alias("passed")).agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    spark = scored.sparkSession
    steps = spark.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "step int, threshold double")
    totals = sums.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    met = F.broadcast(steps).join(sums, F.col("passed") >= F.col("step"), "left").groupBy("step", "threshold").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    n = (F.col("all_pos") + F.col("all_neg")).cast("double")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return met.crossJoin(totals).select("threshold", (F.col("tp") / n - F.col("fp") / n * odds).alias("model"), (F.col("all_pos") / n - F.col("all_neg") / n * odds).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def subgroup_audit(scored: DataFrame, group: str, min_n: int = 40, n_boot: int = 0, seed: int = 0) -> DataFrame:
    """group, n, positives, sufficient, auc, calibration_gap; metrics are NULL for groups that are too small or have one class.

    With n_boot also auc_lo and auc_hi, from so many resamples of each sufficient group.
    """
    head = scored.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    areas = auc(scored, [group]).withColumnRenamed(group, "_g")
    enough = (F.col("n") >= min_n) & (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    joined = head.join(areas, head[group].eqNullSafe(F.col("_g")), "left")
    audit = joined.select(group, "n", "positives", enough.alias("sufficient"), F.when(enough, F.col("auc")).alias("auc"), F.when(enough, F.col("gap")).alias("calibration_gap"))
    if not n_boot:
        return audit
    large = audit.where("sufficient").select(F.col(group).alias("_g"))
    members = scored.join(F.broadcast(large), scored[group].eqNullSafe(F.col("_g")), "left_semi")  # a row a group
    bounds = bootstrap(members.select(group, "y", "p"), [group], n_boot, seed).where("metric = 'roc_auc'").select(F.col(group).alias("_g"), F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi"))
    return audit.join(F.broadcast(bounds), audit[group].eqNullSafe(F.col("_g")), "left").drop("_g")


def presence_auc(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """feature, auc of "is measured" as a score: how much missingness tells about the label."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().cast("double").alias("p")) for c in columns])).alias("f"))
    return auc(long.select("y", "f.feature", "f.p"), ["feature"])


def univariate_auc(df: DataFrame, columns: list[str], label: str = "y", buckets: int = 64) -> DataFrame:
    """feature, auc, the larger of both directions; rows without the feature are left out."""
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("p")) for c in columns])).alias("f")).select("y", "f.feature", "f.p")
    # Buckets of each feature between its extremes; a bucket only bounds a window's rows, so uneven ones do no harm.
    ends = long.groupBy("feature").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    wide = long.join(F.broadcast(ends), "feature")  # a row a column
    at = F.coalesce(F.floor(F.try_divide(F.col("p") - F.col("low"), F.col("high") - F.col("low")) * buckets), F.lit(0))
    return _ranked(wide.withColumn("slot", at)).select("feature", F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def _ranked(long: DataFrame) -> DataFrame:
    found = long.where(F.col("p").isNotNull()).groupBy("feature", "slot", "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))
    ordered = _below(found, ["feature"], F.col("slot"))
    return ordered.groupBy("feature").agg(F.try_divide(F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).cast("double"), 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def trivial_rule(df: DataFrame, columns: list[str], label: str = "y") -> DataFrame:
    """accuracy, false_positives, false_negatives of "any column is above zero"; a missing value is not above."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns])
    y = F.col(label) == 1
    return df.agg(F.avg((hit == y).cast("double")).alias("accuracy"), F.count_if(hit & ~y).alias("false_positives"), F.count_if(~hit & y).alias("false_negatives"))


# Resampling ---------------------------------------------------------------------------------------


#: Cells of one bucket, which a task holds, and the sampled cells a bucket from which its edges come.
CELLS, SAMPLED = 200_000, 20
METRICS = ("roc_auc", "pr_auc", "brier", "ece")
_SUMS = ("wins", "ap", "squares", *[f"{name}{i}" for name in ("n", "p", "y") for i in range(BINS)])


def _shares(p: np.ndarray, pos: np.ndarray, neg: np.ndarray, above: tuple[int, int], totals: tuple[int, int]) -> list[float]:
    """What ascending cells add to each sum of _SUMS. above: positives and negatives with larger scores; totals: those of all cells."""
    pos, neg = pos.astype(np.float64), neg.astype(np.float64)
    tp, fp = above[0] + np.cumsum(pos[::-1])[::-1], above[1] + np.cumsum(neg[::-1])[::-1]
    wins = (pos * (2 * (totals[1] - fp) + neg)).sum()
    ap = (pos * tp / np.maximum(tp + fp, 1)).sum()
    squares = (pos * (1 - p) ** 2 + neg * p**2).sum()
    known = (p >= 0) & (p <= 1)
    bins = np.searchsorted([i * (1.0 / BINS) for i in range(1, BINS)], p[known], side="right")
    n = pos[known] + neg[known]
    sums = [np.bincount(bins, w, BINS) for w in (n, n * p[known], pos[known])]
    return [wins, ap, squares, *np.concatenate(sums)]


def _drawn(rng: np.random.Generator, total: int, counts: np.ndarray) -> np.ndarray:
    return rng.multinomial(total, counts / counts.sum()) if total else np.zeros(len(counts), np.int64)


def _dealt(before: np.ndarray, bucket: int, n_boot: int, seed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that each replicate deals to bucket and to the buckets above it. before: rows before each bucket, and all rows.

    A replicate's rows are split binomially between a range's halves, by the range's own seed, down to single buckets. So all tasks
    agree on every range, and a task draws its bucket's path only.
    """
    own, above = np.full(n_boot, before[-1]), np.zeros(n_boot, np.int64)
    low, high = 0, len(before) - 1
    while high - low > 1:
        mid, whole = (low + high) // 2, before[high] - before[low]
        left = np.random.default_rng([*seed, low, high]).binomial(own, (before[mid] - before[low]) / whole if whole else 0.0)
        if bucket < mid:
            above, own, high = above + own - left, left, mid
        else:
            own, low = own - left, mid
    return own, above


def _edges(found: DataFrame, cells_each: int) -> np.ndarray:
    """Scores between which about cells_each cells lie, from the cells whose scores' hashes are smallest; none for few cells."""
    buckets = -(-found.count() // cells_each)
    if buckets < 2:
        return np.zeros(0)
    sample = found.select("p").distinct().orderBy(F.xxhash64("p"), "p").limit(SAMPLED * buckets)  # SAMPLED rows a bucket
    p = np.sort(np.array([r["p"] for r in sample.collect()]))
    return np.unique(p[np.arange(1, buckets) * len(p) // buckets])


def bootstrap(scored: DataFrame, keys: list[str] = (), n_boot: int = 2000, seed: int = 0, cells_each: int = CELLS) -> DataFrame:
    """keys, metric, point, lo, hi: the METRICS and the 2.5 and 97.5 percentiles over resamples of rows within each class.

    Drawing counts of cells is the same as drawing rows with replacement, so replicates cost cells, not rows. A
    replicate first draws how many rows of each class fall to each bucket of scores, by halves of halves, of which a task repeats
    its own bucket's from the seed, then a task draws its own bucket's cells; knowing what lies above them it adds its shares of all
    metrics, which Spark sums. A task holds one bucket's cells, however many there are; the driver a few numbers a
    bucket. Key values are meant to be few. With one class the areas are NULL, without keys and rows all are.
    """
    keys, spark = list(keys), scored.sparkSession
    found = cells(scored.withColumn("p", F.col("p").cast("double")), keys).cache()
    try:
        edges = spark.sparkContext.broadcast(_edges(found, cells_each))

        @F.pandas_udf("int")
        def bucket_of(p: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges.value, p.to_numpy(), side="right").astype(np.int32))

        placed = found.withColumn("_bucket", bucket_of("p") if len(edges.value) else F.lit(0))
        sums = placed.groupBy(*keys, "_bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()  # a row a bucket
        groups = sorted({tuple(r[k] for k in keys) for r in sums}, key=lambda g: [(v is not None, str(v)) for v in g]) or ([()] if not keys else [])
        number, buckets = {g: i for i, g in enumerate(groups)}, len(edges.value) + 1
        counts = np.zeros((len(groups), 2, buckets), np.int64)
        for r in sums:
            counts[number[tuple(r[k] for k in keys)], :, r["_bucket"]] = r["pos"], r["neg"]
        held = spark.sparkContext.broadcast(np.concatenate([np.zeros((len(groups), 2, 1), np.int64), counts.cumsum(axis=2)], axis=2))
        blocks = max(1, -(-spark.sparkContext.defaultParallelism // (buckets * max(1, len(groups)))))

        def replicated(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
            group, bucket, block = map(int, key)
            cell = cell.sort_values("p")
            p, own = cell["p"].to_numpy(), [cell[c].to_numpy() for c in ("pos", "neg")]
            before = held.value[group]
            totals = tuple(int(c[-1]) for c in before)
            asked = [_dealt(c, bucket, n_boot, (seed, group, label)) for label, c in enumerate(before)]
            out = []
            for i in range(block - 1, n_boot, blocks):  # -1: the rows as they are
                if i >= 0:
                    rng = np.random.default_rng([seed, group, i, 1 + bucket])
                    drawn, above = [_drawn(rng, int(d[i]), c) for (d, _), c in zip(asked, own)], tuple(int(a[i]) for _, a in asked)
                else:
                    drawn, above = own, tuple(int(c[-1] - c[bucket + 1]) for c in before)
                out.append([group, i, *_shares(p, *drawn, above, totals)])
            return pd.DataFrame(out, columns=["_group", "_i", *_SUMS])

        wanted = spark.createDataFrame([(i, *g) for i, g in enumerate(groups)], "_group int" + "".join(f", `_k{j}` {found.schema[k].dataType.simpleString()}" for j, k in enumerate(keys)))
        same = reduce(lambda c, j: c & F.col(f"_k{j}").eqNullSafe(F.col(keys[j])), range(len(keys)), F.lit(True))
        numbered = placed.join(F.broadcast(wanted), same) if keys else placed.withColumn("_group", F.lit(0))
        dealt = numbered.select("_group", "_bucket", "p", "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
        shares = dealt.groupBy("_group", "_bucket", "_block").applyInPandas(replicated, f"_group int, _i int, {', '.join(f'{c} double' for c in _SUMS)}")
        all_of = spark.createDataFrame([(i, float(c[0].sum()), float(c[1].sum())) for i, c in enumerate(counts)], "_group int, _pos double, _neg double")
        values = shares.groupBy("_group", "_i").agg(*[F.sum(c).alias(c) for c in _SUMS]).join(F.broadcast(all_of), "_group")
        gaps = reduce(lambda a, b: a + b, [F.abs(F.col(f"p{i}") - F.col(f"y{i}")) for i in range(BINS)])
        inside = reduce(lambda a, b: a + b, [F.col(f"n{i}") for i in range(BINS)])
        both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
        found_values = [F.when(both, F.col("wins") / (2 * F.col("_pos") * F.col("_neg"))), F.when(both, F.col("ap") / F.col("_pos")), F.col("squares") / (F.col("_pos") + F.col("_neg")), F.coalesce(F.try_divide(gaps, inside), F.lit(0.0))]
        long = values.select("_group", "_i", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in zip(METRICS, found_values)])).alias("v")).select("_group", "_i", "v.*")
        bounds = F.percentile(F.when(F.col("_i") >= 0, F.col("value")), F.array(F.lit(0.025), F.lit(0.975)))
        measured = long.groupBy("_group", "metric").agg(F.max(F.when(F.col("_i") < 0, F.col("value"))).alias("point"), bounds.alias("b"))
        got = {(r["_group"], r["metric"]): (r["point"], *(r["b"] or (None, None))) for r in measured.collect()}  # four rows a key
    finally:
        found.unpersist()
    rows = [(*g, m, *got.get((i, m), (None, None, None))) for i, g in enumerate(groups) for m in METRICS]
    return spark.createDataFrame(rows, "".join(f"`{k}` {found.schema[k].dataType.simpleString()}, " for k in keys) + "metric string, point double, lo double, hi double")
