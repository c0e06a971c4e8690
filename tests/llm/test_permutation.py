"""Recall of the permutation index beyond the least that is asked, and dimensions with few pivots."""

import numpy as np
import pyarrow.parquet as pq

from marrow.llm import permutation


def exact(ids, matrix, query, k):
    scores = matrix @ matrix[query]
    scores[query] = -np.inf
    return {ids[i] for i in np.argsort(-scores, kind="stable")[:k]}


def test_recall_has_a_margin_on_a_larger_table(spark):
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    ids, matrix = table["vec_id"], np.array(table["embedding"], float)
    found = {}
    for r in permutation.nearest(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 20, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & exact(ids, matrix, i, 20)) for i, q in enumerate(ids) if q % 20 == 0]
    assert np.mean(hits) >= 0.95 * 20


def test_a_dimension_with_few_pivots_is_searched_whole(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1200)] + [(i, rng.normal(size=16).tolist()) for i in range(1200, 1500)] + [(i, rng.normal(size=4).tolist()) for i in range(1500, 1510)]
    found = {}
    for r in permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20, pivots=64).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    ids, matrix = [i for i, x in rows if len(x) == 16], np.array([x for _, x in rows if len(x) == 16])
    for i, q in enumerate(ids):
        if q % 20 == 0:
            assert found[q] == exact(ids, matrix, i, 20)
