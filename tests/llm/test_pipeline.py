"""The corpus pipeline's stages, one after another, each against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marrow.llm import toxicity
from marrow.llm.queries import fitted_toxicity
from tests.llm.test_archive_lines_shards import brute_lines
from tests.llm.test_nearcopies import brute
from tests.llm.test_tokens import check_packing, reference_ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(documents before, documents after) of each stage, as lists of rows."""
    at, folder, out = spark.read.parquet(f"{SF}/documents.parquet"), tmp_path_factory.mktemp("stages"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == at.columns
        out.append((at.collect(), after.collect()))
        at = after
    return out


def test_rejected_documents_go_and_others_stay_unchanged(spark, steps):
    before, after = steps[0]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fitted_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    stays = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in after} == stays
    assert {tuple(r) for r in after} == {tuple(r) for r in before if r.doc_id in stays}


def test_repeated_lines_go(steps):
    before, after = steps[1]
    wanted = {i: text for i, _, _, text in brute_lines([(r.doc_id, r.text) for r in before], 5)}
    assert {r.doc_id: r.text for r in after} == wanted and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after if wanted[r.doc_id] != {b.doc_id: b.text for b in before}[r.doc_id])


def test_one_document_of_each_group_stays(steps):
    """Groups are those of five-word shingles at similarity 0.8, the definition that stages on shingles have."""
    before, after = steps[2]
    assert sorted(r.doc_id for r in after) == sorted(brute([(r.doc_id, r.text) for r in before]))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_packing_keeps_every_id(steps):
    before, after = steps[3]
    check_packing(after, dict(zip([r.doc_id for r in before], reference_ids([r.text for r in before]))))


def test_near_duplicates_with_ids_that_repeat(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words entirely here"), (None, "x y z w"), (None, "x y z w"), (2, "A b c d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from marrow.llm import simhash

    kept = sorted((tuple(r) for r in simhash.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, "a b c d"), (1, "other words entirely here"), (None, "x y z w"), (3, None)], key=repr)


def test_run_returns_pieces(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_stages_carry_columns_whatever_their_names(spark):
    from marrow.llm import lines, nearcopies, simhash

    line = "a line that is long enough to count as repeated"
    rows = [(i, f"{line}\nown words of document number {i} and no other one") for i in range(6)]
    names = ["_drop", "_drop_id", "_lines", "_row", "_id", "_fp", "_own", "_n_lines", "_n_dropped", "_kept", "_score", "root", "fp", "n"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"'x' AS `{n}`" for n in names])
    assert lines.dedup_lines(docs, names=("a", "b", "c")).where("b = 1 and `_drop` = 'x'").count() == 5
    assert simhash.keep_one(docs).columns == docs.columns and nearcopies.keep_one(docs).columns == docs.columns
    assert nearcopies.keep_one(docs).where("`_row` = 'x'").count() == 6
    after = corpus_pipeline.drop_repeated_lines(spark, docs.withColumn("n_chars", F.lit(1)), "")
    assert {r.text.count(line) for r in after.collect()} == {0, 1} and after.where("`_kept` <> 'x'").isEmpty()
