"""Known answers on small inline tables, and mutations that a guard must notice.

The inline rows and their answers are fixed values.
"""

import gzip
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrow.functions import scalar
from marrow.operators import boosting, calibrate, checks, cleaning, conformal, integrity, metrics, resample
from marrow.sources import tables


def scored(spark, y, p, **more):
    names = ["row_id", "y", "p", *more]
    return spark.createDataFrame([(i, a, float(b), *c) for i, (a, b, *c) in enumerate(zip(y, p, *more.values()))], names)


def one(df):
    return df.first()[0]


def test_ece_and_bins(spark):
    df = scored(spark, [0, 1, 1, 0, 1, 1], [0.1, 0.2, 0.4, 0.5, 0.8, 0.9])
    assert one(metrics.ece(df, 3)) == pytest.approx(2 / 6 * 0.35 + 2 / 6 * 0.05 + 2 / 6 * 0.15)
    assert one(metrics.ece(scored(spark, [0] * 50 + [1] * 50, [0.95] * 50 + [0.05] * 50))) > 0.8
    # In doubles 3 * 0.1 > 0.3, 6 * 0.1 > 0.6 and 7 * 0.1 > 0.7: such scores lie below the edge.
    bins = metrics.reliability_bins(scored(spark, [1, 1, 1, 1], [0.3, 0.6, 0.7, 1.0])).collect()
    assert {r.bin: r.n for r in bins} == {**dict.fromkeys(range(10), 0), 2: 1, 5: 1, 6: 1, 9: 1}
    assert one(metrics.ece(df.limit(0))) == 0.0


def test_net_benefit(spark):
    df = scored(spark, [1, 1, 1, 0, 0, 0], [0.9, 0.7, 0.4, 0.6, 0.3, 0.1])
    rows = {r.threshold: r for r in metrics.net_benefit(df, (0.5, 0.2)).collect()}
    assert rows[0.5].model == pytest.approx(1 / 6) and rows[0.2].model == pytest.approx(0.5 - 2 / 6 * 0.25)
    assert rows[0.5].treat_all == 0 and rows[0.2].treat_all == pytest.approx(0.375)
    with pytest.raises(ValueError):
        metrics.net_benefit(df, (0.0,))


def test_auc_ap_ties_and_one_class(spark):
    df = scored(spark, [1, 0, 1, 0], [0.5, 0.5, 0.9, 0.1])
    assert one(metrics.auc(df)) == pytest.approx(3.5 / 4)
    assert one(metrics.average_precision(df)) == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert one(metrics.auc(scored(spark, [1, 1], [0.5, 0.6]))) is None
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400).tolist(), np.round(rng.random(400), 3).tolist()
    wins = np.mean([(a > b) + 0.5 * (a == b) for a, i in zip(p, y) if i for b, j in zip(p, y) if not j])
    assert one(metrics.auc(scored(spark, y, p))) == pytest.approx(wins)


def test_small_groups_keep_their_row(spark):
    df = scored(spark, [i % 2 for i in range(140)], [(i * 37 % 100) / 100 for i in range(140)], g=["a"] * 10 + [None] * 130)
    rows = {r.g: r for r in metrics.subgroup_audit(df, "g").collect()}
    assert rows["a"].auc is None and not rows["a"].sufficient and rows["a"].n == 10
    assert rows[None].sufficient and 0 <= rows[None].auc <= 1


def test_conformal(spark):
    y, p = [1, 0, 1, 0, 1, 0, 1, 0, 1], [0.95, 0.10, 0.70, 0.40, 0.50, 0.60, 0.20, 0.85, 0.05]
    for alpha, wanted in ((0.2, 0.85), (0.1, 0.95), (0.01, 0.95)):
        assert one(conformal.q_hat(scored(spark, y, p), alpha)) == pytest.approx(wanted)
    for value, q, wanted in ((0.95, 0.2, "positive"), (0.5, 0.6, "uncertain"), (0.5, 0.3, "positive"), (0.49, 0.3, "negative")):
        assert one(spark.range(1).select(scalar.prediction_set(F.lit(value), q))) == wanted
    judged = conformal.verdicts(scored(spark, y, p), 0.3)
    shares = {r.verdict: r.fraction for r in conformal.verdict_fractions(judged).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["uncertain"] == 0


def test_sentinel_scan(spark):
    cols = {
        "a": [0.0] * 30 + np.linspace(180, 280, 170).tolist(), "b": np.linspace(30, 80, 200).tolist(), "c": [0.0] * 180 + [1.0] * 20,
        "d": [0.0] * 20 + np.linspace(0.1, 6, 180).tolist(), "e": [0.0] * 2 + np.linspace(180, 280, 198).tolist(), "f": [0.0] * 200,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), list(cols)).withColumn("text", F.lit("x"))
    rows = {r.feature: r for r in checks.sentinel_scan(df).collect()}
    assert {k for k, r in rows.items() if r.flagged} == {"a", "f"} and rows["a"].zero_share == pytest.approx(0.15)


def test_split_overlap_counts_repeats_and_missing(spark):
    train = spark.createDataFrame([(i, 10.0 * i) for i in range(1, 6)] + [(9, None)], "a int, b double")
    test = spark.createDataFrame([(1, 10.0), (3, 30.0), (3, 30.0), (99, 999.0), (9, None)], "a int, b double")
    assert tuple(checks.split_overlap(train, test).first()) == (5, 4)


def test_guards_notice_mutations(spark):
    ids = spark.range(10).withColumnRenamed("id", "row_id")
    checks.assert_covered(ids, ids)
    for broken in (ids.where("row_id <> 3"), ids.union(ids.where("row_id = 3"))):
        with pytest.raises(checks.CoverageError):
            checks.assert_covered(ids, broken)
    with pytest.raises(checks.LeakError):
        checks.assert_disjoint(ids.where("row_id < 5"), ids.where("row_id > 3"))
    with pytest.raises(ValueError, match="4 rows"):
        checks.with_groups(ids, ids.where("row_id < 6").withColumn("g", F.lit(1)))


def test_cleaning_and_contract(spark):
    sites = spark.createDataFrame([(0.0, "cleveland"), (0.0, "switzerland"), (None, "va")], "chol double, site string")
    out = [r.chol for r in cleaning.null_sentinels(sites, {"chol": ["switzerland"]}).collect()]
    assert out == [0.0, None, None]
    texts = spark.createDataFrame([("ckd\t", "?"), (" notckd", "12d"), ("ckd", " 5 ")], "c string, n string")
    clean = cleaning.to_numbers(cleaning.tokens_to_null(cleaning.strip_strings(texts)), ["n"])
    assert [tuple(r) for r in clean.collect()] == [("ckd", None), ("notckd", None), ("ckd", 5.0)]
    good = spark.createDataFrame([(1, 0, 1.0), (2, 1, None)], "row_id long, target long, x double")
    assert cleaning.violations(good, cleaning.Contract(rows=2)) == []
    for bad in (good.limit(1), good.withColumn("target", F.lit(2)), good.withColumn("x", F.lit(None).cast("double")), good.drop("target"), good.withColumn("target", F.lit(1.0))):
        with pytest.raises(cleaning.ContractError):
            cleaning.checked(bad, cleaning.Contract(rows=2))
    with pytest.raises(Exception, match="aligned"):
        cleaning.zip_by_position(good, good.where("row_id = 1").select("row_id", F.lit(1).alias("z"))).collect()
    with pytest.raises(Exception, match="no label"):
        texts.select(scalar.label_map(F.col("c"), {"ckd": 1})).collect()


def test_form_values(spark):
    cases = {"": None, "  ": None, "abc": None, "12px": None, "NaN": None, "true": 1, "false": 0, "3.5": 3.5, " 42 ": 42, "0": 0, "-1.5": -1.5, "1e400": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", scalar.form_value(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_folds_split_subsample_and_encoding(spark):
    df = spark.range(101).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    sizes = resample.stratified_folds(df, 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("k")).collect()
    assert max(r.n for r in sizes) - min(r.n for r in sizes) <= 1 and max(r.k for r in sizes) - min(r.k for r in sizes) <= 1
    assert resample.stratified_split(df).where("part = 'calibration' AND y = 1").count() == 8
    assert resample.stratified_subsample(df, 40).count() == 40 and resample.stratified_subsample(df, 500).count() == 101
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a"), (4.0, "b")], "num double, cat string")
    test = spark.createDataFrame([(None, "a"), (1.0, "c"), (2.0, None)], "num double, cat string")
    encoded = resample.one_hot(test, "cat", resample.categories(train, "cat"))
    assert encoded.columns == ["num", "cat_a", "cat_b"]
    assert [tuple(r) for r in encoded.collect()] == [(None, 1, 0), (1.0, 0, 0), (2.0, 0, 0)]


def test_calibrators(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.random(4000), 3)
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * p + 1.5))).astype(int)
    c = calibrate.fit(scored(spark, y.tolist(), p.tolist()), "sigmoid")
    assert c.a == pytest.approx(-3, abs=0.35) and c.b == pytest.approx(1.5, abs=0.25)
    step = (rng.random(4000) < np.where(p < 0.5, 0.05, 0.95)).astype(int)
    df = scored(spark, step.tolist(), p.tolist())
    best = calibrate.pick(df)
    assert best.method == "isotonic" and list(best.x) == sorted(best.x) and list(best.y) == sorted(best.y)
    probe = np.linspace(-0.5, 1.5, 50)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in probe], "p double").select(best.apply(F.col("p"))).collect()]
    assert got == pytest.approx(np.interp(probe, best.x, best.y).tolist(), abs=1e-12)
    assert calibrate.Calibrator.from_json(best.to_json()) == best
    with pytest.raises(ValueError):
        calibrate.fit(df, "other")
    z = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-z))).astype(int)
    shifted = scored(spark, y.tolist(), (1 / (1 + np.exp(-(z + 0.9)))).tolist())
    intercept, slope = calibrate.calibration_in_the_large(shifted)
    assert intercept == pytest.approx(-0.9, abs=0.2) and slope == pytest.approx(1, abs=0.2)
    assert calibrate.fit_intercept(shifted) == pytest.approx(-0.9, abs=0.2)


def test_trees_learn_missing_directions_and_walkers_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    x[rng.random(500) < 0.4, 1] = np.nan
    y = np.isnan(x[:, 1]).astype(float)
    forest = boosting.fit_forest(x, y, 2, 20, 0.3)
    assert ((boosting.margins(forest, x) > 0) == (y == 1)).all()
    y2 = (x[:, 0] + 0.5 * np.nan_to_num(x[:, 1]) > 0).astype(float)
    losses = []
    for trees in (1, 5, 20):
        f = boosting.fit_forest(x, y2, 3, trees, 0.3, ("x0", "x1", "x2"))
        q = 1 / (1 + np.exp(-boosting.margins(f, x)))
        losses.append(-np.mean(y2 * np.log(q) + (1 - y2) * np.log(1 - q)))
    assert losses == sorted(losses, reverse=True)
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "row_id int, x0 double, x1 double, x2 double")
    both = boosting.score_native(boosting.score(df, f, "a"), f, "b").orderBy("row_id").collect()
    for r in both[:100]:
        own = 1 / (1 + math.exp(-boosting.walk(f, [r.x0, r.x1, r.x2])))
        assert r.a == pytest.approx(own, abs=1e-12) and r.b == pytest.approx(own, abs=1e-12)
    with pytest.raises(ValueError):
        boosting.walk(f, [1.0])


def test_float32_comparison_decides(spark):
    t = float(np.float32(0.1))
    forest = boosting.Forest(("x0",), 0.5, (((0, t, 1, 2, 2, 0.0), (-1, 0.0, -1, -1, -1, -1.0), (-1, 0.0, -1, -1, -1, 1.0)),))
    df = spark.createDataFrame([(0.1,)], "x0 double")  # below t as a double, equal to it in single precision
    assert boosting.walk(forest, [0.1]) == 1.0
    assert boosting.score(df, forest).first()["p_raw"] > 0.5 and boosting.score_native(df, forest).first()["p_raw"] > 0.5


def test_sources_and_manifest(spark, tmp_path):
    for name, rows in (("a", "1,x\n2,?\n"), ("b", "3,NA\n")):
        with gzip.open(tmp_path / f"{name}.csv.gz", "wt") as f:
            f.write(rows)
    df = tables.tagged(spark, {k: f"{tmp_path}/{k}.csv.gz" for k in "ab"}, "n int, s string", header=False, null="?")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x", "a"), (2, None, "a"), (3, None, "b")]
    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("deep/inside/one.txt", "one")
    tables.extract(tmp_path / "z.zip", tmp_path / "d", ["one.txt"])
    with pytest.raises(FileNotFoundError):
        tables.extract(tmp_path / "z.zip", tmp_path / "d", ["two.txt"])
    pin = tables.sha256(tmp_path / "d/one.txt")
    assert tables.fetch(tmp_path / "d", {"one.txt": pin}, lambda t: None) == {"one.txt": "OK"}
    with pytest.raises(ValueError):
        tables.fetch(tmp_path / "d", {"one.txt": "0" * 64}, lambda t: None)
    found = integrity.hashes(spark, f"{tmp_path}/d")
    assert [tuple(r) for r in found.collect()] == [("one.txt", pin)]
    status = integrity.compare(spark.createDataFrame([("one.txt", pin), ("gone", "x")], "path string, sha256 string"), found)
    assert {r.path: r.status for r in status.collect()} == {"one.txt": "OK", "gone": "MISSING"}
    for bad in ("/etc/passwd", "../x"):
        with pytest.raises(ValueError):
            integrity.safe_path(tmp_path, bad)
    assert integrity.canonical({"b": float("nan"), "a": [1.5, float("inf")]}) == b'{"a":[1.5,null],"b":null}'


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"n": 3,\n "q": {"alpha": 0.1}, "xs": [1.5, null]}')
    r = tables.json_document(spark, str(tmp_path / "d.json"), "n long, q struct<alpha: double>, xs array<double>, absent string").first()
    assert (r.n, r.q.alpha, r.xs, r.absent) == (3, 0.1, [1.5, None], None)


def test_base_margin_and_bracketed_number_refuse_bad_input(spark):
    for value in (0.0, 1.0, -0.5):
        with pytest.raises(Exception, match="base score outside"):
            spark.createDataFrame([(value,)], "p double").select(scalar.base_margin(F.col("p"))).collect()
    with pytest.raises(Exception, match="more than one number"):
        spark.createDataFrame([("[1,2]",)], "s string").select(scalar.bracketed_number(F.col("s"))).collect()
