"""Vector codes against plain Lloyd rounds in Python integers, and the defined cases."""

import hashlib

import numpy as np
import pytest

from marrow.llm import codes
from marrow.llm.queries import op11_codes


def plain(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label) of one dimension; (vec_id, label, code, error) of each, and the digest."""
    used = [(i, [int(np.floor(1024 * float(v))) for v in x], y) for i, x, y in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    used.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(used[0][1])
    cut = [(dim * p // 4, dim * (p + 1) // 4) for p in range(4)]
    x = [np.array([r[1][b:e] for r in used], object).reshape(len(used), e - b) for b, e in cut]
    books = [part[:entries].copy() for part in x]

    def assigned(p):
        apart = ((x[p][:, None, :] - books[p][None]) ** 2).sum(axis=2)
        return [min(range(len(books[p])), key=lambda j: (row[j], j)) for row in apart], apart

    for _ in range(rounds):
        for p in range(4):
            at, _ = assigned(p)
            for j in set(at):
                own = x[p][[i for i, a in enumerate(at) if a == j]]
                books[p][j] = own.sum(axis=0) // len(own)
    final = [assigned(p) for p in range(4)]
    out = [(r[0], r[2], "".join(f"{final[p][0][i]:02x}" for p in range(4)), int(sum(final[p][1][i][final[p][0][i]] for p in range(4)))) for i, r in enumerate(used)]
    return out, hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()


def got(df):
    return sorted(((r.vec_id, r.label, r.code, r.error) for r in df.collect()), key=str)


@pytest.mark.parametrize("entries,block_rows", [(256, 8192), (16, 150), (7, 10_000)])
def test_codes_equal_plain_rounds(spark, entries, block_rows):
    rng = np.random.default_rng(entries)
    centres = rng.normal(size=(20, 16)) / 4
    rows = [(i, (centres[i % 20] + rng.normal(size=16) * rng.choice([0, 0.001, 0.05])).tolist(), i % 3) for i in range(600)]
    rows += [(1000 + i, centres[0].tolist(), None) for i in range(200)]  # copies
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = codes.compress(df, entries=entries, block_rows=block_rows)
    want, sha = plain(rows, entries)
    assert got(coded) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in coded.collect()} == {sha} == {codes.digest(books[16])}


def test_boxes_drop_entries_and_assign_subtrees(spark, monkeypatch):
    """On separate clusters nearly all rows are assigned by their subtree's cached sum, none one by one."""
    rng = np.random.default_rng(1)
    entries = np.array([[1000 * i, -1000 * i] for i in range(8)])
    x = np.repeat(entries, 400, axis=0) + rng.integers(-5, 6, (3200, 2))
    compared = []
    real = np.bincount
    monkeypatch.setattr(codes.np, "bincount", lambda a, *b, **c: compared.append(len(a)) or real(a, *b, **c))
    at, sums, counts = codes.filtered(x, codes.kd_tree(x), entries)
    assert max(compared) <= 64 and at.tolist() == np.repeat(range(8), 400).tolist() and counts.tolist() == [400] * 8
    assert sums.tolist() == [x[at == j].sum(axis=0).tolist() for j in range(8)]


def test_ties_go_to_the_lower_entry():
    x = np.array([[0], [2], [4], [1], [3]] * 40)
    at, _, _ = codes.filtered(x, codes.kd_tree(x), np.array([[4], [0], [2], [0]]))
    assert at.tolist() == [1, 2, 0, 1, 0] * 40


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-codes.BOUND, codes.BOUND, (300, 16))
    entries = x[:9].astype(np.int64)
    at, sums, _ = codes.filtered(x, codes.kd_tree(x), entries)
    apart = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert at.tolist() == [min(range(9), key=lambda j: (row[j], j)) for row in apart]
    assert sums.sum(axis=0).tolist() == x.sum(axis=0).tolist()


def test_defined_cases(spark):
    rows = [(1, [0.5, 1.0, -1.0, 0.0], 1, "x"), (1, [0.5, 1.0, -1.0, 0.0], 1, "x"), (2, None, 1, "x"), (3, [1.0, None, 0.0, 0.0], 1, "x"), (4, [float("nan")] * 4, 1, "x"), (5, [float("inf")] * 4, 1, "x"),
            (None, [0.25, 0.0, 0.0, 0.0], None, None), (6, [1.0, 2.0], None, None), (7, [], 2, None), (8, [1e300] * 4, 2, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, error string")
    out = codes.with_label_error(codes.compress(df)[0])
    found = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str)
    # Equal vectors fill the first two entries of a small table, and ties go to the lower one.
    assert [f[:2] for f in found] == sorted([(1, "00000000"), (1, "00000000"), (None, "03030300"), (6, "00000000"), (7, "00000000"), (8, "02020202")], key=str)
    assert all(f[2] == 0 and f[3] == 0 for f in found)
    assert codes.compress(df.limit(0))[0].count() == 0 and codes.with_label_error(codes.compress(df.limit(0))[0]).count() == 0


def test_label_errors_with_one_label_of_half_the_rows(spark):
    df = spark.range(1000).selectExpr("id AS vec_id", "IF(id % 2 = 0, NULL, CAST(id % 7 AS INT)) AS label", "hex(id) AS code", "id % 13 AS error")
    want = {}
    for r in df.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    assert all(r.label_error == want[r.label] for r in codes.with_label_error(df).collect()) and codes.with_label_error(df).count() == 1000


def test_query_equals_plain_rounds_on_a_fixture(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want, sha = plain(rows)
    out = op11_codes(spark, d).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == sorted((i, c, e) for i, _, c, e in want)
    assert {r.codebooks_sha256 for r in out} == {sha}
