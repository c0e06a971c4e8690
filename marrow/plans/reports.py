"""A dataset's report: metrics with intervals, bins, net benefit and subgroup audits; and the record of runs."""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.functions import scalar
from marrow.operators import metrics
from marrow.plans import bundle
from marrow.plans.train import Fitted, report

# Which columns of the public datasets tell sex and age, and the survey's codes of five-year age groups by band.
SEX_COLUMNS = {"heart-disease": "sex", "liver-disease": "sex_male", "diabetes": "Sex"}
AGE_COLUMNS = {"cervical-cancer": "Age", "heart-disease": "age", "kidney-disease": "age", "liver-disease": "Age", "diabetes": "Age"}
AGE_CODES = {1: "<45", 2: "<45", 3: "<45", 4: "<45", 5: "<45", 6: "45-54", 7: "45-54", 8: "55-64", 9: "55-64", 10: "65+", 11: "65+", 12: "65+", 13: "65+"}
AGE_IN_CODES = ("diabetes",)
LEAST_GROUP = 40


def subgroup_dimensions(slug: str, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """row_id and the dimensions that the dataset's subgroups are taken from: site, sex, age_band, as far as it has them."""
    dims = {}
    if "site" in df.columns:
        dims["site"] = F.col("site")
    if slug in SEX_COLUMNS:
        dims["sex"] = F.col(f"`{SEX_COLUMNS[slug]}`").cast("int").cast("string")
    if slug in AGE_COLUMNS:
        age = F.col(f"`{AGE_COLUMNS[slug]}`")
        dims["age_band"] = scalar.code_band(age, AGE_CODES) if slug in AGE_IN_CODES else scalar.age_band(age)
    return df.select("row_id", *[c.alias(name) for name, c in dims.items()]), list(dims)


def subgroup_audits(slug: str, df: DataFrame, scored: DataFrame, n_boot: int = 2000) -> DataFrame:
    """dimension, grp, n, positives, sufficient, auc, calibration_gap and intervals, a row a group. scored: row_id, y, p."""
    dims, names = subgroup_dimensions(slug, df)
    joined = scored.select("row_id", "y", "p").join(dims, "row_id")
    audits = [metrics.subgroup_audit(joined.select(F.col(name).alias("grp"), "y", "p"), "grp", LEAST_GROUP, n_boot).select(F.lit(name).alias("dimension"), "*") for name in names]
    return reduce(DataFrame.unionByName, audits) if audits else None


def dataset_report(slug: str, df: DataFrame, fitted: Fitted, alpha: float = 0.1, n_boot: int = 2000) -> dict:
    """Everything that is told about a dataset's model; each table in it has a bounded number of rows."""
    scored = fitted.oof.select("row_id", "y", F.col("p_cal").alias("p")).cache()
    rows = lambda t: [r.asDict() for r in t.collect()]
    try:
        audits = subgroup_audits(slug, df, scored, n_boot)
        groups: dict[str, list] = {}
        for r in rows(audits.orderBy("dimension", F.asc_nulls_last("grp"))) if audits is not None else []:
            groups.setdefault(r.pop("dimension"), []).append(r)
        return {
            "slug": slug, **report(fitted, alpha, n_boot), "settings": list(fitted.settings), "features": list(fitted.forest.features),
            "reliability": rows(metrics.reliability_bins(scored).orderBy("bin")), "net_benefit": rows(metrics.net_benefit(scored).orderBy("threshold")), "subgroups": groups,
        }
    finally:
        scored.unpersist()


def record_run(folder: Path, run: dict) -> dict:
    """Adds a run's datasets to the newest record in folder, as a new version; the result is that version.

    A version is linked to its name only if no other writer has taken that name since the base was read; else its entries are
    merged into the newer base. So writers of different datasets lose nothing, and a version is whole or absent.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    while True:
        at, base = newest_run(folder)
        merged = bundle.merged_runs(base, run)
        draft = folder / f".{uuid.uuid4().hex}"
        draft.write_text(json.dumps(merged, sort_keys=True, indent=2, allow_nan=False) + "\n")
        try:
            os.link(draft, folder / f"runs.{at + 1:06d}.json")
            return merged
        except FileExistsError:
            continue
        finally:
            draft.unlink()


def newest_run(folder: Path) -> tuple[int, dict | None]:
    """The number of the newest record and the record; 0 and None without one."""
    found = sorted(Path(folder).glob("runs.*.json"))
    return (int(found[-1].name.split(".")[1]), json.loads(found[-1].read_text())) if found else (0, None)
