"""The transfer study covers every site and says what brute force says."""

import math

import pytest

from marrow.operators import calibrate
from marrow.plans import views
from marrow.plans.queries import transfer_like_for_like

SF = "/root/testdata/sf0.001"


def test_query_studies_every_other_site(spark):
    wanted = {r["site"]: r["count"] for r in views.scored_orders(spark, SF).where("site <> '1-URGENT'").groupBy("site").count().collect()}
    rows = transfer_like_for_like(spark, SF).collect()
    assert len(wanted) == 4
    assert {r.site: r.n for r in rows if r.block == "naive_all_rows"} == wanted


def chance(key, seed=42):
    x = (key * 1000003 + seed * 7919 + 12345) % 2147483647
    return x * x % 2147483647 * 48271 % 2147483647


def measures(cells):
    pos, neg = [p for y, p in cells if y], [p for y, p in cells if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    return len(cells), auc, sum((p - y) ** 2 for y, p in cells) / len(cells)


def shifted(p, c):
    return 1 / (1 + math.exp(-(math.log(p / (1 - p)) + c)))


def test_study_against_brute_force(spark):
    rows = [(i, int(i * 37 % 11 < 3 + i % 4), (i * 53 % 97 + 1) / 100, "home" if i % 5 == 0 else f"s{i % 5}") for i in range(600)]
    found = calibrate.transfer_study(spark.createDataFrame(rows, "row_id long, y int, p double, site string"), "site", "home").collect()
    by = {(r.site, r.block): r for r in found}
    assert len(found) == len(by) == 12
    for site in ("s1", "s2", "s3", "s4"):
        own, fitted = [r for r in rows if r[3] == site], set()
        for y in (0, 1):
            group = sorted((chance(r[0]), r[0]) for r in own if r[1] == y)
            fitted |= {i for _, i in group[: math.floor(len(group) * 0.3 + 0.5)]}
        low, high = -20.0, 20.0
        for _ in range(100):
            c = (low + high) / 2
            low, high = (c, high) if sum(y - shifted(p, c) for i, y, p, _ in own if i in fitted) > 0 else (low, c)
        held = [(y, p) for i, y, p, _ in own if i not in fitted]
        blocks = {"naive_all_rows": [(y, p) for _, y, p, _ in own], "naive": held, "recalibrated": [(y, shifted(p, c)) for y, p in held]}
        for block, cells in blocks.items():
            r = by[site, block]
            assert (r.n, r.auc, r.brier) == pytest.approx(measures(cells), abs=1e-9)
            assert r.intercept == pytest.approx(c, abs=1e-7)


def test_intervals_of_all_blocks(spark):
    rows = [(i, int(i * 37 % 11 < 3 + i % 4), (i * 53 % 97 + 1) / 100, "home" if i % 3 == 0 else f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, y int, p double, site string")
    plain = {(r.site, r.block): r for r in calibrate.transfer_study(df, "site", "home").collect()}
    found = calibrate.transfer_study(df, "site", "home", n_boot=40).collect()
    assert {(r.site, r.block) for r in found} == set(plain) and len(plain) == 6
    for r in found:
        assert (r.auc, r.brier, r.ece) == pytest.approx((plain[r.site, r.block].auc, plain[r.site, r.block].brier, plain[r.site, r.block].ece))
        assert r.auc_lo <= r.auc <= r.auc_hi and r.brier_lo <= r.brier <= r.brier_hi
        assert 0 < r.pr_auc_lo <= r.pr_auc <= r.pr_auc_hi <= 1 and 0 <= r.ece_lo <= r.ece_hi <= 1
