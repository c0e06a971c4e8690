"""Portable model bundles: one JSON document that scores rows anywhere, with canaries to prove it."""

from __future__ import annotations

import gzip
import json
import math
import subprocess
from pathlib import Path

import numpy as np

from marrow.operators import boosting
from marrow.operators.calibrate import Calibrator
from marrow.operators.integrity import canonical, json_safe

SCHEMA_VERSION = 1
# The number of canaries, and how many blanks the last ones have.
CANARIES, BLANKS = 8, {6: 3, 7: 4}
#: Stored for other implementations; this one is held to SELF_CHECK.
TOLERANCE, SELF_CHECK = 1e-9, 1e-12
#: Of a bundle in gzip.
MOST_BYTES = 300 * 1024
NODE = ("f", "t", "l", "r", "m", "v")


def commit_info(root: Path) -> dict:
    """The commit and its time, or nulls outside a repository."""
    def git(*args: str) -> str | None:
        try:
            out = subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True, timeout=15)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return out.stdout.strip() or None if out.returncode == 0 else None

    return {"commit": git("rev-parse", "HEAD"), "built_utc": git("log", "-1", "--format=%cI"), "author": git("log", "-1", "--format=%an")}


def assemble(name: str, forest: boosting.Forest, calibrator: Calibrator, q_hat: float, alpha: float, features: list[dict], root: Path, seed: int = 42) -> dict:
    """features: name, kind, low, high in the forest's order; another order is an error."""
    if [f["name"] for f in features] != list(forest.features):
        raise ValueError("features differ from the forest's, or stand in another order")
    model = {
        "schema_version": SCHEMA_VERSION, "condition": name,
        "trees": [[dict(zip(NODE, node)) for node in tree] for tree in forest.trees],
        "base_score": math.log(forest.base / (1 - forest.base)), "base_score_probability": forest.base,
        "calibrator": calibrator.to_json(), "conformal": {"q_hat": q_hat, "alpha": alpha}, "features": features, "provenance": commit_info(root),
    }
    rng = np.random.default_rng(seed)
    inputs = [[float(rng.random() < 0.5) if f["kind"] == "binary" else float(rng.uniform(f["low"], f["high"])) for f in features] for _ in range(CANARIES)]
    numeric = [i for i, f in enumerate(features) if f["kind"] != "binary"]
    for at, n in BLANKS.items():
        for i in rng.choice(numeric, min(n, len(numeric)), replace=False) if numeric else []:
            inputs[at][int(i)] = None
    model["canaries"] = {"inputs": inputs, "p_cal": [predict(model, row)["p_cal"] for row in inputs], "tolerance": TOLERANCE}
    return model


def forest_of(model: dict) -> boosting.Forest:
    trees = tuple(tuple(tuple(node[k] for k in NODE) for node in tree) for tree in model["trees"])
    for tree in trees:
        for f, t, l, r, m, v in tree:
            if f >= 0 and not (0 <= f < len(model["features"]) and {l, r} <= set(range(len(tree))) and m in (l, r) and float(np.float32(t)) == t):
                raise ValueError("a node is malformed")
    return boosting.Forest(tuple(f["name"] for f in model["features"]), model["base_score_probability"], trees)


def _calibrated(c: Calibrator, p: float) -> float:
    if c.method == "sigmoid":
        return 1 / (1 + math.exp(c.a * p + c.b))
    return float(np.interp(p, c.x, c.y))


def predict(model: dict, row: list[float | None]) -> dict:
    """p_raw, p_cal and verdict of one row."""
    z = boosting.walk(forest_of(model), row)
    raw = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
    p, q = _calibrated(Calibrator.from_json(model["calibrator"]), raw), model["conformal"]["q_hat"]
    positive, negative = 1 - p <= q, p <= q
    verdict = "uncertain" if positive and negative else "positive" if positive or (not negative and p >= 0.5) else "negative"
    return {"p_raw": raw, "p_cal": p, "verdict": verdict}


def self_check(model: dict) -> float:
    """The largest gap between stored and repeated canary scores."""
    held = model["canaries"]
    return max(abs(predict(model, row)["p_cal"] - p) for row, p in zip(held["inputs"], held["p_cal"]))


def save(model: dict, path: Path, most_bytes: int = MOST_BYTES) -> None:
    """A bundle that gzip can't bring below most_bytes is an error: it is meant to be sent to where rows are."""
    data = canonical(model)
    if (size := len(gzip.compress(data, mtime=0))) > most_bytes:
        raise ValueError(f"the bundle has {size} bytes in gzip, more than {most_bytes}")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def load(path: Path) -> dict:
    return json.loads(Path(path).read_text())


def merged_runs(old: dict | None, run: dict) -> dict:
    """Run metadata after another run: its datasets replace their own entries, the earliest start stays, seconds add up."""
    old = old or {"datasets": {}}
    datasets = {**old["datasets"], **run["datasets"]}
    starts = [r["started"] for r in datasets.values()]
    return json_safe({"datasets": datasets, "started": min(starts), "seconds": sum(r["seconds"] for r in datasets.values())})
