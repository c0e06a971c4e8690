"""Command line: fetch, clean, train, evaluate, external, export, verify and predict, each a thin call of the library."""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marrow.operators import boosting, calibrate, cleaning, conformal, integrity, metrics
from marrow.plans import bundle, registry, reports
from marrow.plans.train import report, train
from marrow.sources import sinks

ALPHA = 0.1
HOME_SITE = "cleveland"


def session() -> SparkSession:
    return SparkSession.builder.appName("marrow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(document: dict) -> None:
    print(json.dumps(integrity.json_safe(document), indent=2, sort_keys=True, default=str))


def _clean_table(spark: SparkSession, root: Path, slug: str):
    return spark.read.parquet(str(root / "cleaned" / slug))


def clean(args) -> int:
    spark = session()
    for slug in args.condition or registry.DATASETS:
        registry.clean(spark, slug, args.root / "raw" / slug).write.mode("overwrite").parquet(str(args.root / "cleaned" / slug))
    return 0


def fetch(args) -> int:
    """Prints every file's status; a file without its pinned hash, or one that is missing, is status 1."""
    pins = json.loads(args.pins.read_text()) if args.pins else {}
    for slug in args.condition or registry.DATASETS:
        try:
            status = registry.fetch(slug, args.root / "raw", args.source.format(slug=slug), pins.get(slug), args.force)
        except (OSError, ValueError) as e:
            print(f"{slug}: {e}", file=sys.stderr)
            return 1
        for name, state in status.items():
            print(f"{state:9} {slug}/{name}")
    return 0


def train_command(args) -> int:
    spark = session()
    for slug in args.condition or registry.DATASETS:
        began, started = time.time(), datetime.now(timezone.utc).isoformat()
        clean_df = _clean_table(spark, args.root, slug)
        df, features = registry.encoded(clean_df)
        fitted = train(df.withColumnRenamed("target", "y"), features, seed=args.seed, search_rows=registry.SEARCH_ROWS.get(slug))
        fitted.oof.write.mode("overwrite").parquet(str(args.root / "oof" / slug))
        out = reports.dataset_report(slug, clean_df, fitted, ALPHA, args.n_boot)
        ranges = [{"name": r["feature"], "kind": r["kind"], "low": r["low"], "high": r["high"]} for r in cleaning.feature_ranges(df, features).collect()]
        model = bundle.assemble(slug, fitted.forest, fitted.calibrator, out["q_hat"], ALPHA, ranges, args.root)
        (args.root / "models" / slug).mkdir(parents=True, exist_ok=True)
        bundle.save(model, args.root / "models" / slug / "model.json")
        sinks.json_report(out, args.root / "models" / slug / "metrics.json")
        reports.record_run(args.root / "models", {"datasets": {slug: {"started": started, "seconds": time.time() - began, "seed": args.seed, "n_boot": args.n_boot, "alpha": ALPHA}}})
    return 0


def evaluate(args) -> int:
    spark = session()
    for slug in args.condition or registry.DATASETS:
        scored = spark.read.parquet(str(args.root / "oof" / slug)).select("y", F.col("p_cal").alias("p"))
        bounds = {r["metric"]: [r["lo"], r["hi"]] for r in metrics.bootstrap(scored, n_boot=args.n_boot).collect()}
        _show({"condition": slug, **metrics.evaluation(scored).first().asDict(), "intervals": bounds, "q_hat": conformal.q_hat(scored, ALPHA).first()["q_hat"]})
    return 0


def external(args) -> int:
    """Fits on one site's rows alone and scores the other sites' rows with that forest and its calibrator."""
    spark = session()
    df, features = registry.encoded(_clean_table(spark, args.root, "heart-disease"))
    df = df.withColumnRenamed("target", "y")
    fitted = train(df.where(F.col("site") == HOME_SITE), features, seed=args.seed)
    raw = boosting.score(df.where(F.col("site") != HOME_SITE), fitted.forest, "p_raw")
    scored = calibrate.calibrated(raw, fitted.calibrator, "p_raw", "p").select("row_id", "site", "y", "p")
    home = {"site": HOME_SITE, **report(fitted, ALPHA, args.n_boot), "settings": list(fitted.settings), "features": features}
    _show({"home": home, "rows": [r.asDict() for r in calibrate.transfer_study(scored, "site", HOME_SITE, n_boot=args.n_boot).collect()]})
    return 0


def export(args) -> int:
    for slug in args.condition or registry.DATASETS:
        gap = bundle.self_check(bundle.load(args.root / "models" / slug / "model.json"))
        print(f"{slug}: canaries within {gap:.3g}")
        if gap > bundle.SELF_CHECK:
            return 1
    return 0


def verify(args) -> int:
    spark = session()
    stored = json.loads((args.root / "manifest.json").read_text())["artifacts"]
    outside = []
    for path in stored:
        try:
            integrity.safe_path(args.root, path)
        except ValueError:
            outside.append(path)
            print(f"{'INVALID_PATH':9} {path}")
    expected = spark.createDataFrame([(p, h) for p, h in stored.items() if p not in outside], "path string, sha256 string")
    rows = integrity.compare(expected, integrity.artifacts(spark, args.root)).where("status <> 'UNLISTED'").collect()
    for r in rows:
        print(f"{r['status']:9} {r['path']}")
    return int(bool(outside) or any(r["status"] != "OK" for r in rows))


def manifest(args) -> int:
    spark = session()
    hashed = integrity.artifacts(spark, args.root)
    sinks.json_report(integrity.manifest(hashed, bundle.commit_info(args.root)), args.root / "manifest.json")
    return 0


def settings(pairs: list[str], names: list[str]) -> dict[str, float]:
    """feature=value pairs as numbers; three kinds of error end the program with status 2."""
    out = {}
    for pair in pairs:
        name, equals, value = pair.partition("=")
        try:
            if not equals:
                raise ValueError(f"expected feature=value, got {pair!r}")
            if name not in names:
                raise ValueError(f"unknown feature {name!r}")
            out[name] = float(value)
        except ValueError as e:
            print(f"error: {e}", file=sys.stderr)
            raise SystemExit(2) from e
    return out


def predict(args) -> int:
    model = bundle.load(args.root / "models" / args.condition / "model.json")
    names = [f["name"] for f in model["features"]]
    given = settings(args.set, names)
    out = bundle.predict(model, [given.get(n) for n in names])
    if args.json:
        _show({"condition": args.condition, **out, "provenance": model["provenance"]})
    else:
        print(f"{args.condition}: p_raw {out['p_raw']:.6f}, p_cal {out['p_cal']:.6f}, {out['verdict']}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marrow")
    top.add_argument("--root", type=Path, default=Path("."))
    sub = top.add_subparsers(required=True)
    for name, f in (("clean", clean), ("train", train_command), ("evaluate", evaluate), ("export", export)):
        p = sub.add_parser(name)
        p.add_argument("--condition", action="append", choices=list(registry.DATASETS))
        p.add_argument("--seed", type=int, default=42)
        if f in (train_command, evaluate):
            p.add_argument("--n-boot", type=int, default=2000)
        p.set_defaults(run=f)
    for name, f in (("external", external), ("manifest", manifest), ("verify", verify)):
        p = sub.add_parser(name)
        p.add_argument("--seed", type=int, default=42)
        if f is external:
            p.add_argument("--n-boot", type=int, default=2000)
        p.set_defaults(run=f)
    p = sub.add_parser("fetch")
    p.add_argument("--condition", action="append", choices=list(registry.DATASETS))
    p.add_argument("--source", required=True, help="folder, URL or zip archive; {slug} stands for the dataset")
    p.add_argument("--pins", type=Path, help="JSON: dataset -> file -> SHA-256")
    p.add_argument("--force", action="store_true")
    p.set_defaults(run=fetch)
    p = sub.add_parser("predict")
    p.add_argument("--condition", required=True, choices=list(registry.DATASETS))
    p.add_argument("--set", action="append", default=[], metavar="FEATURE=VALUE")
    p.add_argument("--json", action="store_true")
    p.set_defaults(run=predict)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
