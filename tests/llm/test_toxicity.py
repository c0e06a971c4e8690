"""Toxicity: accuracy on rows that were not learned from, and odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marrow.llm import toxicity
from marrow.llm.queries import op2_toxicity

SYLLABLES = "ka lo mi ten dar vo su pel ri gan ob zu fe lin mar tos".split()
MARKS = ["grumbosh", "vexilard", "snarpling"]


def corpus(n, seed):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(MARKS))
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_held_out_accuracy_and_scale():
    model = toxicity.fit_sample(*corpus(600, 1))
    texts, y = corpus(400, 2)
    p = toxicity.scores(model, pa.array(texts))
    assert ((p >= 0.5) == (y == 1)).mean() > 0.97
    assert ((0 <= p) & (p <= 1)).all()
    marked = " ".join(texts[1].split()[:40] * 300 + MARKS * 40)  # far into a long text
    assert toxicity.scores(model, pa.array([marked]))[0] > 0.5


def test_cache_and_slices_never_change_scores(monkeypatch):
    model = toxicity.fit_sample(*corpus(300, 3))
    texts, _ = corpus(60, 4)
    whole = toxicity.Margins(model.toxic, model.ordinary).features(pa.array(texts), [3])[0]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 5)
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 300)
    assert (toxicity.Margins(model.toxic, model.ordinary).features(pa.array(texts), [3])[0] == whole).all()


def test_odd_texts_and_labels(spark):
    texts, y = corpus(300, 5)
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, ""), (1002, " \n"), (None, "x"), (1003, "w" * 300_000), (1003, "!!!")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*((i, int(v)) for i, v in enumerate(y)), (None, 1), (5, None), (1000, 1)], "doc_id long, toxic int").withColumn("text", F.lit(1))
    model = toxicity.fit(docs, labels, F.lit(True))
    out = toxicity.score(docs, model, name="s").collect()
    assert len(out) == docs.count() and all(0 <= r.s <= 1 for r in out)
    plain = {r.s for r in out if r.doc_id in (1000, 1001, 1002)}
    assert len(plain) == 1 and plain.pop() < 0.5
    assert toxicity.score(docs.limit(0), model, name="s").count() == 0
    for label, wanted in ((0, 0.0), (1, 1.0)):
        single = toxicity.fit(docs, labels.where(f"toxic = {label}"), F.lit(True))
        assert {r.s for r in toxicity.score(docs, single, name="s").collect()} == {wanted}
    assert toxicity.fit(docs, labels.limit(0), F.lit(True)).prior == 0.0


def test_query_marks_held_out_rows(spark):
    rows = op2_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
