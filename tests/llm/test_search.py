"""Searches and near-duplicates against brute force."""

import math
import re

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from marrow.llm import permutation, simhash, topk
from marrow.llm import vectors as vectors_module
from marrow.llm.queries import op3_topk, op5_simhash, op10_permutation

SF = "/root/testdata/sf0.001"


def vectors():
    return {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()}


def brute(rows, every, k, score):
    out = []
    for q in sorted(rows):
        if q % every == 0:
            best = sorted((-score(rows[q], x), i) for i, x in rows.items() if i != q and len(x) == len(rows[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def whole(a, b):
    return sum(math.floor(256 * float(x)) * math.floor(256 * float(y)) for x, y in zip(a, b))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_topk_of_embeddings(spark):
    assert rows_of(op3_topk(spark, SF)) == brute(vectors(), 50, 5, whole)


def test_topk_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.integers(-2, 3, 5).astype(float).tolist() for i in range(120)}
    rows |= {200 + i: [0.0] * 5 for i in range(4)} | {300: [1.0, 2.0], 350: [3.0, -1.0], 400: [1e12, 2.0, 0.0, 0.0, 0.0], -50: [1.0] * 5}
    bad = [(500, None), (550, []), (600, [1.0, None, 0.0, 0.0, 0.0]), (650, [math.nan] * 5), (700, [math.inf] * 5), (None, [1.0] * 5), (0, rows[0])]
    df = spark.createDataFrame([*rows.items(), *bad], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    for block in (7, 1000):
        assert rows_of(topk.top_k(df, 10, 5, block=block, query_block=3)) == sorted(brute(rows, 10, 5, whole))
    assert topk.top_k(df.limit(0), 10, 5).count() == 0


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 13)), rng.normal(size=(50, 13)) + 1
    exact, last = a @ b.T, np.inf
    for s in topk.LEVELS:
        bound = topk.segment_features(a, s) @ topk.segment_features(b, s).T
        assert (bound >= exact - 1e-9).all()
        assert bound.mean() <= last
        last = bound.mean()


def test_permutation_recall_and_scores(spark):
    rows = vectors()
    exact = brute(rows, 20, 20, lambda a, b: float(np.dot(np.array(a, float), np.array(b, float))))
    found = rows_of(op10_permutation(spark, SF))
    true = {(q, i): s for q, _, i, s in exact}
    assert len(found) == len(exact)
    hits = sum((q, i) in true for q, _, i, _ in found)
    assert hits >= 0.9 * len(exact)
    for q in {x[0] for x in found}:
        own = [x for x in found if x[0] == q]
        assert [x[1] for x in own] == list(range(1, 21))
        assert [(-x[3], x[2]) for x in own] == sorted((-x[3], x[2]) for x in own)
    for q, _, i, s in found:
        assert abs(s - np.dot(np.array(rows[q], float), np.array(rows[i], float))) < 1e-12


def test_permutation_recall_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    rows = {i: x.tolist() for i, x in enumerate(rng.normal(size=(3000, 64)))}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    matrix = np.array(list(rows.values()))
    found, hits = {}, 0
    for q, _, i, _ in rows_of(permutation.nearest(df, 60, 20, block=500)):
        found.setdefault(q, set()).add(i)
    for q, ids in found.items():
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hits += len(ids & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 50 and hits >= 0.9 * 20 * 50


def test_permutation_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [math.nan, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (20, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    assert rows_of(permutation.nearest(df, 20, 20)) == [(0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 1, 0.5)]
    assert permutation.nearest(df.limit(0), 20, 20).count() == 0


def reference_print(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reference_components(prints, max_bits=2):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    todo = list(parent)
    for i, a in enumerate(todo):
        for b in todo[i + 1 :]:
            if (a ^ b).bit_count() <= max_bits:
                parent[root(a)] = root(b)
    return {p: root(p) for p in parent}


def test_simhash_of_documents(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    prints = {d["doc_id"]: reference_print(d["text"]) for d in docs}
    roots = reference_components(set(prints.values()))
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    assert rows_of(op5_simhash(spark, SF)) == sorted((d, f"{p:016x}", least[roots[p]]) for d, p in prints.items())


def test_simhash_odd_texts(spark):
    texts = [None, "", " \n\x0b", "One", "one", "ONE two", "a b c", "a  b\tc", "É a b", "é a b", "w " * 40_000, "x y z x y z"]
    df = spark.createDataFrame([*enumerate(texts), (None, "one"), (None, "lonely words here"), (3, "One")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(texts) + 3
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert by[i].fp % (1 << 64) == reference_print(t)
    assert [by[i].component_id for i in (0, 1, 2, 3, 4, 6, 7)] == [0, 0, 0, 3, 3, 6, 6]
    assert {r.component_id for r in rows if r.doc_id is None} == {3, None}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_find_every_pair_with_and_without_hot_cells(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64).tolist() + [0, -1]
    values = set(base)
    for b in base:
        for _ in range(12):
            v = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                v ^= 1 << int(bit)
            values.add(((v + (1 << 63)) % (1 << 64)) - (1 << 63))
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for max_bits in (0, 1, 2):
        roots = reference_components([v % (1 << 64) for v in values], max_bits)
        wanted = len(set(roots.values()))
        for hot in (1, 3, 1000):
            found = simhash.components(simhash.links(df, f"{tmp_path}/{max_bits}-{hot}", max_bits, hot_cell=hot), f"{tmp_path}/c{max_bits}-{hot}").collect()
            to = {v: v for v in values} | {r.node: r.root for r in found}
            assert len(set(to.values())) == wanted
            assert all(roots[r.node % (1 << 64)] == roots[r.root % (1 << 64)] for r in found)


def test_different_vectors_under_one_id_are_candidates(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (10, [0.25, 1.0]), (10, [0.25, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1, 100):
        found = rows_of(topk.top_k(df, 10, 9, scale=4.0, block=block))
        assert found == [(0, 1, 3, 32), (0, 2, 3, 8), (0, 3, 10, 4), (0, 4, 10, 4), (10, 1, 3, 8), (10, 2, 0, 4), (10, 3, 3, 2)]
        assert [r[2:] for r in rows_of(permutation.nearest(df, 10, 9, block=block)) if r[0] == 0] == [(3, 2.0), (3, 0.5), (10, 0.25), (10, 0.25)]


def test_block_pairs_are_grouped_into_a_fixed_number_of_pieces():
    for held, q_held in ((1, 1), (3, 2), (12_208, 611), (122_071, 6_104), (50_000, 1), (40, 5_000)):
        c_groups, q_groups = vectors_module.groups(held, q_held)
        assert 1 <= c_groups <= held and 1 <= q_groups <= q_held
        assert c_groups * q_groups <= max(vectors_module.PARTS, -(-q_held // vectors_module.QUERY_GROUP))
        assert -(-q_held // q_groups) <= vectors_module.QUERY_GROUP


def test_searches_over_grouped_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors_module, "groups", lambda held, q_held: (min(3, held), min(2, q_held)))
    rng = np.random.default_rng(11)
    rows = {i: rng.integers(-2, 3, 6).astype(float).tolist() for i in range(300)} | {1000 + i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(90)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    assert rows_of(topk.top_k(df, 10, 5, block=20, query_block=4)) == sorted(brute(rows, 10, 5, whole))
    found = rows_of(permutation.nearest(df.where("vec_id < 300"), 10, 5, pivots=8, listed=4, share=1.0, block=20, query_block=4))
    assert found == sorted(brute({i: x for i, x in rows.items() if i < 300}, 10, 5, lambda a, b: float(np.dot(a, b))))


def test_blocks_of_wide_vectors_are_bounded_in_bytes(spark):
    df = spark.range(600).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4_096)), lambda i: (i * 7 + F.col("id")).cast("double") % 5).alias("vector"))
    number = vectors_module.pieces(df, 8_192)
    held = vectors_module.blocks(df, number, lambda m: (m, b"")).selectExpr("length(matrix) AS n").collect()
    assert number == 5 and sum(r.n for r in held) == 600 * 4_096 * 8
    assert max(r.n for r in held) < 2 * vectors_module.BLOCK_BYTES
