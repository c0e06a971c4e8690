"""Cleaning: transforms of whole frames, and the contract that a cleaned table must keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrow.functions import scalar


class ContractError(ValueError):
    """A cleaned table breaks its contract."""


def columns_of(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)


def feature_columns(df: DataFrame, label: str = "target", others: tuple[str, ...] = ("site", "row_id")) -> list[str]:
    return [c for c in df.columns if c != label and c not in others]


def strip_strings(df: DataFrame) -> DataFrame:
    return df.withColumns({c: scalar.strip(F.col(c)) for c in string_columns(df)})


def tokens_to_null(df: DataFrame, token: str = "?") -> DataFrame:
    return df.withColumns({c: scalar.token_to_null(F.col(c), token) for c in string_columns(df)})


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: scalar.to_number(F.col(c)) for c in columns})


def nans_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({c: scalar.finite(F.col(c)) for c in columns_of(df, T.DoubleType, T.FloatType)})


def null_sentinels(df: DataFrame, sites: dict[str, list[str]], site: str = "site") -> DataFrame:
    """Zeros to NULL, for each column at its listed sites; an empty list means everywhere."""
    def scoped(c: str, at: list[str]):
        return (F.col(c) == 0) & (F.col(site).isin(at) if at else F.lit(True))

    return df.withColumns({c: scalar.null_where(F.col(c), scoped(c, at)) for c, at in sites.items()})


def zip_by_position(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Two tables that are aligned row by row, joined on the row number both carry; unequal sets of numbers are an error."""
    joined = left.join(right.withColumnRenamed(key, "_right"), F.col(key) == F.col("_right"), "full_outer")
    bad = F.raise_error(F.lit("tables aren't aligned")).cast("long")
    return joined.withColumn(key, F.when(F.col(key).isNull() | F.col("_right").isNull(), bad).otherwise(F.col(key))).drop("_right")


@dataclass(frozen=True)
class Contract:
    rows: int | None = None
    label: str = "target"
    domain: tuple[int, ...] = (0, 1)


def violations(df: DataFrame, contract: Contract) -> list[str]:
    """What breaks the contract, in the order of its rules, from one aggregate over all columns."""
    label, found = contract.label, []
    has_label = label in df.columns
    aggs = [F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{i}") for i, c in enumerate(df.columns)]]
    if has_label:
        inside = F.col(label).isin(*contract.domain)
        aggs += [F.count_if(~F.coalesce(inside, F.lit(False))).alias("_outside"), *[F.count_if(F.col(label) == v).alias(f"_v_{i}") for i, v in enumerate(contract.domain)]]
    r = df.agg(*aggs).first()
    if contract.rows is not None and r["_rows"] != contract.rows:
        found.append(f"expected {contract.rows} rows, got {r['_rows']}")
    if not has_label:
        found.append(f"missing column {label!r}")
    else:
        if not isinstance(df.schema[label].dataType, T.IntegralType):
            found.append(f"{label} is {df.schema[label].dataType.simpleString()}, not an integer")
        if r["_outside"] or not all(r[f"_v_{i}"] for i in range(len(contract.domain))):
            found.append(f"values of {label} are not exactly {set(contract.domain)}")
    empty = [c for i, c in enumerate(df.columns) if r["_rows"] and not r[f"_n_{i}"]]
    if empty:
        found.append(f"columns without any value: {empty}")
    return found


def checked(df: DataFrame, contract: Contract) -> DataFrame:
    """df itself; the first violation is raised."""
    for v in violations(df, contract):
        raise ContractError(v)
    return df


def null_profile(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """group, n, and each column's share of missing values."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in columns])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n; missing values are a group."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def mode(df: DataFrame, column: str) -> DataFrame:
    """value, n of the commonest value; of equally common ones the smallest. One partial maximum a task, no sort."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("minus"), F.col("value"))).alias("best")
    return counts.agg(most).select(F.col("best.value").alias("value"), (-F.col("best.minus")).alias("n"))


def decimals_needed(df: DataFrame, column: str, most: int = 4) -> DataFrame:
    """places: the fewest decimals, up to most, that represent all values."""
    ok = [F.coalesce(F.bool_and(scalar.decimals_hold(F.col(column), d)), F.lit(True)) for d in range(most)]
    out = F.lit(most)
    for d in reversed(range(most)):
        out = F.when(ok[d], d).otherwise(out)
    return df.agg(out.cast("int").alias("places"))


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, kind, low, high from one aggregate."""
    row = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)], *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)])
    kinds = {f.name: "binary" if isinstance(f.dataType, T.BooleanType) else "number" for f in df.schema}
    parts = [F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("kind"), F.col(f"lo_{i}").alias("low"), F.col(f"hi_{i}").alias("high")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*parts)).alias("f")).select("f.*")


@dataclass(frozen=True)
class Recipe:
    """A table's cleaning as a chain of DataFrame transforms, then its contract."""

    steps: tuple = field(default_factory=tuple)
    contract: Contract = Contract()

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return checked(df, self.contract)
