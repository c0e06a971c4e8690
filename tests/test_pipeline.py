"""Training end to end on a small signal, bundles, registry and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrow import cli
from marrow.operators import boosting, cleaning, metrics
from marrow.plans import bundle, registry
from marrow.plans.train import predict, report, train
from marrow.sources import sinks
from marrow.streaming import scoring


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.7, size=240) > 0).astype(int)
    x[rng.random(240) < 0.1, 1] = np.nan
    table = pd.DataFrame(x, columns=["a", "b", "c"]).assign(row_id=range(240), y=y)
    df = cleaning.nans_to_null(spark.createDataFrame(table))
    return df, train(df, ["a", "b", "c"], grid=((2, 15, 0.2), (3, 15, 0.2)))


def test_training_covers_rows_and_finds_the_signal(spark, fitted):
    df, f = fitted
    assert f.oof.count() == 240 and f.oof.select("row_id").distinct().count() == 240
    out = report(f, n_boot=50)
    assert out["auc"] > 0.75 and sum(out["verdicts"].values()) == pytest.approx(1)
    assert out["ece"] > 1e-6  # cross-fitted scores are not perfectly calibrated
    assert out["intervals"]["roc_auc"][1] <= out["intervals"]["roc_auc"][0] <= out["intervals"]["roc_auc"][2]
    judged = predict(df, f, out["q_hat"])
    assert set(judged.columns) == {*df.columns, "p_raw", "p_cal", "verdict"} and judged.where("verdict IS NULL").count() == 0


def test_bundle_round_trip_and_cli(fitted, tmp_path, capsys):
    df, f = fitted
    ranges = [{"name": r["feature"], "kind": r["kind"], "low": r["low"], "high": r["high"]} for r in cleaning.feature_ranges(df, ["a", "b", "c"]).collect()]
    model = bundle.assemble("heart-disease", f.forest, f.calibrator, 0.6, 0.1, ranges, tmp_path)
    path = tmp_path / "models/heart-disease/model.json"
    bundle.save(model, path)
    assert bundle.self_check(bundle.load(path)) <= bundle.SELF_CHECK
    assert sum(v is None for v in model["canaries"]["inputs"][6]) == 3
    with pytest.raises(ValueError):
        bundle.assemble("x", f.forest, f.calibrator, 0.6, 0.1, ranges[::-1], tmp_path)
    assert cli.main(["--root", str(tmp_path), "predict", "--condition", "heart-disease", "--set", "a=1.5", "--json"]) == 0
    assert '"p_cal"' in capsys.readouterr().out
    for bad in ("a", "z=1", "a=x"):
        with pytest.raises(SystemExit) as e:
            cli.main(["--root", str(tmp_path), "predict", "--condition", "heart-disease", "--set", bad])
        assert e.value.code == 2
    assert cli.main(["--root", str(tmp_path), "manifest"]) == 0 and cli.main(["--root", str(tmp_path), "verify"]) == 0
    path.write_bytes(path.read_bytes() + b" ")
    assert cli.main(["--root", str(tmp_path), "verify"]) == 1


def test_stream_scores_like_a_batch(spark, fitted, tmp_path):
    df, f = fitted
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    scoring.start(scoring.scored_stream(stream, f.forest), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    streamed = {r.row_id: r.p_raw for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert streamed == {r.row_id: r.p_raw for r in boosting.score(df, f.forest).collect()}


def test_heart_and_kidney_recipes(spark, tmp_path, monkeypatch):
    for site, chol in (("cleveland", 0), ("hungarian", 1), ("switzerland", 0), ("va", 9)):
        (tmp_path / registry.HEART_SITES[site]).write_text(f"63,1,1,{0 if site == 'va' else 145},{chol},1,2,150,0,2.3,3,0,?,{2 if site == 'va' else 0}\n")
    monkeypatch.setitem(registry.DATASETS, "heart-disease", registry.Dataset("heart-disease", (), 4))
    contract = cleaning.Contract(rows=4)
    df = registry.CLEANERS["heart-disease"](spark, tmp_path)
    rows = {r.site: r for r in df.collect()}
    assert rows["cleveland"].chol == 0 and rows["switzerland"].chol is None and rows["va"].trestbps is None and rows["va"].target == 1
    assert cleaning.violations(df, contract) == ["columns without any value: ['thal']"]
    (tmp_path / "features.csv").write_text("age,rbc,sc\n48, normal,1.2\n7,\t?,NA\n62,abnormal,1.8\n")
    (tmp_path / "targets.csv").write_text("class\nckd\nckd\t\nnotckd\n")
    kidney = registry.CLEANERS["kidney-disease"](spark, tmp_path)
    assert [(r.age, r.rbc, r.sc, r.target) for r in kidney.orderBy("row_id").collect()] == [(48.0, "normal", 1.2, 1), (7.0, "?", None, 1), (62.0, "abnormal", 1.8, 0)]
    encoded, features = registry.encoded(kidney)
    assert features == ["age", "sc", "rbc_?", "rbc_abnormal", "rbc_normal"]
    assert registry.registry_table(spark).count() == 6


def test_sink_bytes_repeat(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, s string")
    for name in "ab":
        sinks.gzip_csv(df.repartition(2), tmp_path / name, ["k"])
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    assert metrics.evaluation(spark.createDataFrame([(1, 0.9), (0, 0.2)], "y int, p double")).first()["auc"] == 1.0
    assert df.where(F.col("s").isNull()).count() == 1


def test_merged_runs():
    a = bundle.merged_runs(None, {"datasets": {"x": {"started": "2024-01-02", "seconds": 3.0}}})
    b = bundle.merged_runs(a, {"datasets": {"y": {"started": "2024-01-01", "seconds": 4.0}}})
    assert b["started"] == "2024-01-01" and b["seconds"] == 7.0 and set(b["datasets"]) == {"x", "y"}
