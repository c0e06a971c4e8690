"""The toxicity sample is fitted by a task; its texts don't come to the driver."""

import numpy as np
from pyspark import TaskContext
from pyspark.sql import functions as F

from marrow.llm import toxicity

from .test_toxicity import corpus


def test_fit_runs_in_a_task_and_equals_the_fit_of_its_rows(spark, monkeypatch):
    texts, toxic = corpus(300, 3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").collect()]
    want, one = toxicity.fit_sample([texts[i] for i in order], np.array([toxic[i] for i in order], float)), toxicity.fit_sample

    def in_task(texts, toxic):
        assert TaskContext.get() or not texts, "a fit on the driver"
        return one(texts, toxic)

    monkeypatch.setattr(toxicity, "fit_sample", in_task)
    got = toxicity.fit(docs, labels, F.lit(True))
    assert (got.toxic, got.ordinary, got.threshold, got.prior) == (want.toxic, want.ordinary, want.threshold, want.prior)
    assert np.allclose(got.weights, want.weights)
