"""Reports by subgroup, the record of runs under concurrent writers, downloads with pins, named artifacts and the bundle's size."""

import hashlib
import json
import threading
import zipfile

import numpy as np
import pytest

from marrow import cli
from marrow.operators import boosting, calibrate, integrity
from marrow.plans import bundle, registry, reports
from marrow.sources import tables


def scored_rows(n=400):
    rng = np.random.default_rng(5)
    return [(i, int(rng.random() < 0.2 + 0.6 * (i % 10) / 10), float(np.round(0.05 + 0.9 * (i % 10) / 10, 3))) for i in range(n)]


def test_dimensions_and_audits(spark):
    rows = scored_rows()
    scored = spark.createDataFrame(rows, "row_id long, y int, p double")
    clean = spark.createDataFrame([(i, float(30 + i % 50), float(i % 2), "va" if i < 20 else "cleveland") for i, _, _ in rows], "row_id long, age double, sex double, site string")
    out = {(r.dimension, r.grp): r for r in reports.subgroup_audits("heart-disease", clean, scored, 20).collect()}
    assert {d for d, _ in out} == {"site", "sex", "age_band"} and {g for d, g in out if d == "age_band"} == {"<45", "45-54", "55-64", "65+"}
    assert out["site", "va"].n == 20 and not out["site", "va"].sufficient and out["site", "va"].auc is None
    r = out["sex", "1"]
    assert r.n == 200 and r.auc_lo <= r.auc <= r.auc_hi
    assert r.calibration_gap == pytest.approx(abs(np.mean([y for i, y, _ in rows if i % 2]) - np.mean([p for i, _, p in rows if i % 2])))
    codes = spark.createDataFrame([(i, float(1 + i % 13), 0.0) for i in range(13)], "row_id long, Age double, Sex double")
    found, names = reports.subgroup_dimensions("diabetes", codes)
    assert names == ["sex", "age_band"]
    assert [r.age_band for r in found.orderBy("row_id").collect()] == ["<45"] * 5 + ["45-54"] * 2 + ["55-64"] * 2 + ["65+"] * 4
    assert reports.subgroup_audits("breast-cancer", codes, scored, 0) is None


def test_two_writers_lose_no_run(tmp_path):
    def write(k):
        for i in range(8):
            reports.record_run(tmp_path, {"datasets": {f"d{k}-{i}": {"started": f"2024-01-0{k + 1}", "seconds": 1.0}}})

    writers = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    at, last = reports.newest_run(tmp_path)
    assert at == 32 and len(last["datasets"]) == 32 and last["seconds"] == 32.0 and last["started"] == "2024-01-01"
    assert all(p.name.startswith("runs.") for p in tmp_path.iterdir())


def test_downloads_are_checked_before_they_count(tmp_path, capsys):
    source = tmp_path / "source"
    source.mkdir()
    (source / "features.csv").write_text("a\n1\n")
    (source / "targets.csv").write_text("y\n0\n")
    pins = {f: hashlib.sha256((source / f).read_bytes()).hexdigest() for f in ("features.csv", "targets.csv")}
    raw = tmp_path / "raw"
    assert registry.fetch("liver-disease", raw, str(source), {"features.csv": pins["features.csv"]}) == {"features.csv": "OK", "targets.csv": "UNPINNED"}
    with pytest.raises(KeyError):
        registry.fetch("other", raw, str(source))
    # A wrong pin, or a download that breaks off, leaves nothing that counts as complete.
    with pytest.raises(tables.PinError):
        registry.fetch("kidney-disease", raw, str(source), {"features.csv": "0" * 64})

    def breaks(target):
        (target / "features.csv").write_text("half")
        raise OSError("line lost")

    with pytest.raises(OSError):
        tables.fetch(raw / "diabetes", dict.fromkeys(("features.csv", "targets.csv")), breaks)
    assert sorted(p.name for p in raw.iterdir()) == ["liver-disease"]
    # A complete target isn't downloaded again, and a changed file is told, not mended.
    assert tables.fetch(raw / "liver-disease", pins, breaks) == dict.fromkeys(pins, "OK")
    (raw / "liver-disease" / "features.csv").write_text("changed")
    with pytest.raises(tables.PinError):
        tables.fetch(raw / "liver-disease", pins, breaks)
    assert registry.fetch("liver-disease", raw, str(source), pins, force=True) == dict.fromkeys(pins, "OK")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        for f in pins:
            z.write(source / f, f"deep/{f}")
    (tmp_path / "pins.json").write_text(json.dumps({"breast-cancer": pins}))
    assert cli.main(["--root", str(tmp_path), "fetch", "--condition", "breast-cancer", "--source", str(tmp_path / "all.zip"), "--pins", str(tmp_path / "pins.json")]) == 0
    assert capsys.readouterr().out.split() == ["OK", "breast-cancer/features.csv", "OK", "breast-cancer/targets.csv"]
    assert cli.main(["--root", str(tmp_path), "fetch", "--condition", "diabetes", "--source", str(tmp_path / "nowhere")]) == 1


def test_manifests_name_artifacts_only(spark, tmp_path):
    for name in ("models/a/model.json", "models/a/notes.txt", "models/runs.000001.json", "cleaned/a.csv.gz", "models/b/metrics.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    found = {r.path: r.sha256 for r in integrity.artifacts(spark, tmp_path).collect()}
    assert found == {n: hashlib.sha256(n.encode()).hexdigest() for n in ("models/a/model.json", "cleaned/a.csv.gz", "models/b/metrics.json")}
    assert integrity.artifacts(spark, tmp_path / "none").count() == 0


def test_large_files_are_read_piece_by_piece(spark, tmp_path):
    """A file beyond what a binary column holds, and hashes of chunks."""
    with (tmp_path / "large.bin").open("wb") as f:
        f.truncate((1 << 31) + 10)
    assert integrity.artifacts(spark, tmp_path, ("*.bin",)).first().sha256 == hashlib.file_digest((tmp_path / "large.bin").open("rb"), "sha256").hexdigest()
    data = bytes(range(256)) * 10
    (tmp_path / "a.txt").write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    found = {r.path: r.root for r in integrity.chunk_roots(spark, tmp_path, ("*.txt",), 1000).collect()}
    root = lambda parts: hashlib.sha256("".join(hashlib.sha256(p).hexdigest() for p in parts).encode()).hexdigest()
    assert found == {"a.txt": root([data[:1000], data[1000:2000], data[2000:]]), "empty.txt": root([b""])}


def test_large_bundles_are_refused(tmp_path):
    with pytest.raises(ValueError, match="bytes in gzip"):
        bundle.save({"x": [float(v) for v in np.random.default_rng(0).random(50_000)]}, tmp_path / "m.json")
    assert not (tmp_path / "m.json").exists()
    bundle.save({"x": 1}, tmp_path / "m.json")


def test_lines_of_all_groups_at_once(spark):
    rows = [(i, int(i * 37 % 11 < 3 + i % 4), (i * 53 % 97 + 1) / 100, f"s{i % 3}" if i % 3 else None) for i in range(300)] + [(900 + i, 1, 0.3 + i / 100, "one") for i in range(9)]
    df = spark.createDataFrame(rows, "row_id long, y int, p double, site string")
    out = {r.site: r for r in calibrate.fit_lines(df, ["site"]).collect()}
    assert set(out) == {None, "s1", "s2", "one"} and out["one"].calibration_slope is None
    for site in ("s1", "s2"):
        want = calibrate.calibration_in_the_large(df.where(df.site == site))
        assert (out[site].calibration_intercept, out[site].calibration_slope) == pytest.approx(want, abs=1e-8)
    study = calibrate.transfer_study(df.where("site is null or site <> 'one'").fillna("home", "site"), "site", "home").collect()
    by = {(r.site, r.block): r for r in study}
    for site in ("s1", "s2"):  # moving all log-odds by a constant moves the intercept and leaves the slope
        a, b = by[site, "naive"], by[site, "recalibrated"]
        assert a.calibration_slope == pytest.approx(b.calibration_slope, abs=1e-7)
        assert a.calibration_intercept - b.calibration_intercept == pytest.approx(a.calibration_slope * a.intercept, abs=1e-7)


def test_a_dataset_report_has_all_its_tables(spark):
    rows = scored_rows()
    oof = spark.createDataFrame([(i, y, p, p, i % 5) for i, y, p in rows], "row_id long, y int, p double, p_cal double, fold int")
    fitted = reports.Fitted(oof, boosting.Forest(("x",), 0.4, ()), calibrate.Calibrator("sigmoid", a=-1.0, b=0.0), (2, 100, 0.1))
    clean = spark.createDataFrame([(i, float(20 + i % 60), float(i % 2)) for i, _, _ in rows], "row_id long, Age double, sex_male double")
    out = reports.dataset_report("liver-disease", clean, fitted, n_boot=10)
    assert len(out["reliability"]) == 10 and len(out["net_benefit"]) == 99 and set(out["subgroups"]) == {"sex", "age_band"}
    assert out["slug"] == "liver-disease" and out["n"] == 400 and sum(r["n"] for r in out["subgroups"]["sex"]) == 400
    json.dumps(integrity.json_safe(out))
