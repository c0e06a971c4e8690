"""Guards against leaks and against values that stand for missing ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.operators.cleaning import numeric_columns


class LeakError(ValueError):
    """Rows are used on both sides of a split."""


class CoverageError(ValueError):
    """Rows are not scored exactly once."""


def sentinel_scan(df: DataFrame, columns: list[str] | None = None, min_share: float = 0.05) -> DataFrame:
    """feature, zero_share, flagged for every numeric column with values.

    A column is flagged if enough of its values are zero, it is no 0/1 indicator, and zero lies below the
    lower fence (first quartile less 1.5 interquartile ranges) of its other values, or it has none.
    """
    columns = [c for c in (columns or df.columns) if c in numeric_columns(df)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f")).select("f.*").where("v IS NOT NULL")
    other = F.when(F.col("v") != 0, F.col("v"))
    s = long.groupBy("feature").agg(
        F.avg((F.col("v") == 0).cast("double")).alias("zero_share"), F.min("v").alias("low"), F.max("v").alias("high"),
        F.count_if(~F.col("v").isin(0.0, 1.0)).alias("elsewhere"), F.percentile(other, F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
    )
    indicator = (F.col("elsewhere") == 0) & (F.col("low") == 0) & (F.col("high") == 1)
    fence = F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])
    flagged = F.when(F.col("zero_share") < min_share, False).when(indicator, False).when((F.col("low") == 0) & (F.col("high") == 0), True).otherwise(fence > 0)
    return s.select("feature", "zero_share", flagged.alias("flagged"))


def split_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """n_test, n_overlap: test rows that occur in train, by all shared columns; missing equals missing. Every repeated test row counts."""
    shared = [c for c in test.columns if c in train.columns]
    known = train.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(shared)]).distinct().withColumn("_hit", F.lit(1))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(shared)])
    return test.join(known, same, "left").agg(F.count(F.lit(1)).alias("n_test"), F.count("_hit").alias("n_overlap"))


def assert_disjoint(calibration: DataFrame, evaluation: DataFrame, key: str = "row_id") -> None:
    n = calibration.join(evaluation.select(key).distinct(), key, "left_semi").count()
    if n:
        raise LeakError(f"{n} rows are used for calibration and for evaluation")


def with_groups(rows: DataFrame, groups: DataFrame, key: str = "row_id") -> DataFrame:
    """rows joined with their groups; rows without one are an error that tells how many."""
    missing = rows.join(groups, key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows have no group")
    return rows.join(groups, key)


def coverage(ids: DataFrame, scored: DataFrame, key: str = "row_id") -> DataFrame:
    """n, missing, repeated: how many ids there are, how many are never scored and how many more than once."""
    counts = scored.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("seen"))
    joined = ids.select(key).join(counts, F.col(key) == F.col("_k"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen").isNull()).alias("missing"), F.count_if(F.col("seen") > 1).alias("repeated"))


def assert_covered(ids: DataFrame, scored: DataFrame, key: str = "row_id") -> None:
    r = coverage(ids, scored, key).first()
    if r["missing"] or r["repeated"]:
        raise CoverageError(f"{r['missing']} rows without a score, {r['repeated']} with several")
