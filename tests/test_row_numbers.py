"""Row numbers across files that split differently, and folds of very large keys."""

from pyspark.sql import functions as F

from marrow.operators import resample
from marrow.plans import registry


def test_files_that_split_unequally_are_aligned(spark, tmp_path):
    n, columns = 60_000, 12
    wide = "\n".join([",".join(f"c{j}" for j in range(columns)), *(",".join(str(i * columns + j) for j in range(columns)) for i in range(n))])
    (tmp_path / "features.csv").write_text(wide + "\n")
    (tmp_path / "targets.csv").write_text("t\n" + "\n".join(str(i) for i in range(n)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(300_000))
    try:
        pair = registry._pair(spark, tmp_path).cache()
        assert spark.read.csv(str(tmp_path / "features.csv")).rdd.getNumPartitions() > spark.read.csv(str(tmp_path / "targets.csv")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert pair.count() == n
    assert pair.where((F.col("c0").cast("long") != F.col("t").cast("long") * columns) | (F.col("row_id") != F.col("t").cast("long"))).isEmpty()


def test_folds_of_large_keys(spark):
    keys = [10**13 + i for i in range(50)] + [2**63 - 1 - i for i in range(50)] + [-(2**63) + i for i in range(10)]
    df = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "row_id long, y int")
    sizes = [r["n"] for r in resample.stratified_folds(df, 5).groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_a_bad_path_in_a_manifest_is_a_status(spark, tmp_path, capsys):
    import json

    from marrow import cli

    (tmp_path / "models" / "a").mkdir(parents=True)
    (tmp_path / "models" / "a" / "model.json").write_text("{}")
    assert cli.main(["--root", str(tmp_path), "manifest"]) == 0
    assert cli.main(["--root", str(tmp_path), "verify"]) == 0
    document = json.loads((tmp_path / "manifest.json").read_text())
    document["artifacts"]["../outside"] = "0" * 64
    (tmp_path / "manifest.json").write_text(json.dumps(document))
    capsys.readouterr()
    assert cli.main(["--root", str(tmp_path), "verify"]) == 1
    out = capsys.readouterr().out
    assert "INVALID_PATH ../outside" in out and "OK" in out
