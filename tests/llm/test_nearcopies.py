"""The pipeline's near-dedup stage against brute-force similarity of five-word shingles."""

import glob
import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from marrow.llm import nearcopies, shared


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Ids that stay: the smallest of each component of pairs with similarity 0.8 at least."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in root}


def planted():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], [[rng.choice(words) for _ in range(rng.choice([6, 30, 120, 300]))] for _ in range(40)]
    tail = [rng.choice(words) for _ in range(60)]
    for t in texts:
        rows.append(t)
        for edits in (1, 2, 4, 8):
            copy = list(t)
            for at in rng.sample(range(len(t)), min(edits, len(t))):
                copy[at] = rng.choice(words)
            rows.append(copy)
        rows.append(t + tail)
    chain = [rng.choice(words) for _ in range(150)]
    for _ in range(80):  # one large group whose ends are unlike
        chain = list(chain)
        chain[rng.randrange(150)] = rng.choice(words)
        rows.append(chain)
    rows += [["a", "b"], ["A", "b"], ["a", "c"], []]
    rng.shuffle(rows)
    return [(i, " ".join(r)) for i, r in enumerate(rows)]


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    wanted = brute(rows)
    assert sorted(r.doc_id for r in after) == sorted(wanted)
    assert {tuple(r) for r in after} <= set(rows)


def test_common_shingles_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "SAMPLED", 1)
    rows = planted()
    after = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in after) == sorted(brute(rows))


def test_lists_dealt_to_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LIST_PART", 4)
    rows = planted()
    after = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in after) == sorted(brute(rows))


def test_pairs_of_a_hot_list_are_whole_and_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "LIST_PART", 16)
    rng = random.Random(3)
    many = 400  # one list holds half of all posts
    lengths = {node: rng.choice([4, 5, 6, 100, 110, 125, 126, 157]) for node in range(many)}
    rows = [(0, node, lengths[node], many) for node in lengths]
    rows += [(1 + node // 4, many + node, 50, 4) for node in range(many)]
    posts = spark.createDataFrame(rows, "key long, node long, n int, _many long")
    posts = posts.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), nearcopies._parts()).cast("int"))
    found = [tuple(sorted(r)) for r in nearcopies._list_pairs(posts).select("a.node", "b.node").collect()]
    assert len(found) == len(set(found))
    close = {(a, b) for a in lengths for b in lengths if a < b and 4 * max(lengths[a], lengths[b]) <= 5 * min(lengths[a], lengths[b])}
    assert close <= set(found) and len([p for p in found if p[0] < many]) < many * (many - 1) // 2
    others = {(a, b) for k in range(many // 4) for a in range(many + 4 * k, many + 4 * k + 4) for b in range(a + 1, many + 4 * k + 4)}
    assert {p for p in found if p[0] >= many} == others
    for first in (True, False):
        assert nearcopies._cells(posts, first).groupBy("key", "cell").count().agg(F.max("count")).first()[0] <= 32
    mixed = posts.groupBy("key").agg(F.max("_many").alias("_many"), F.min(F.struct("node")).alias("c"))
    stars = nearcopies._star_pairs(posts.drop("_many"), mixed)
    assert stars.select("a.node").distinct().count() == stars.count() == 2 * many
    assert {(r[0], r[1]) for r in stars.select("a.node", "b.node").collect() if r[0] < many} == {(node, 0) for node in range(many)}
    assert stars.groupBy("key", "part").count().agg(F.max("count")).first()[0] <= 64


def test_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b c d"), (1, "a  B c d"), (1, "other words"), (None, "x y"), (None, "x y"), (2, "A b c d"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, (r.text or "").lower().split()) for r in nearcopies.keep_one(docs).collect())
    assert kept == [(0, ["x", "y"]), (1, ["a", "b", "c", "d"]), (1, ["other", "words"]), (3, [])]
    assert nearcopies.keep_one(docs.limit(0)).count() == 0


def test_sketches_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for n, shared in ((40, 30), (300, 100), (900, 880), (1100, 1000), (3000, 10)):
        a = rng.integers(-(2**63), 2**63, n)
        b = np.concatenate([a[:shared], rng.integers(-(2**63), 2**63, n // 2)])
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert np.bitwise_count(nearcopies.sketch(a).view("u8") ^ nearcopies.sketch(b).view("u8")).sum() <= apart
        assert nearcopies.wide_apart(nearcopies.wide_sketch(a), nearcopies.wide_sketch(b)) <= apart
    assert nearcopies.wide_apart(nearcopies.wide_sketch(a), nearcopies.wide_sketch(b)) > apart / 3


def test_shuffle_files_go_with_their_step(spark):
    before = _shuffle_files(spark)
    kept = nearcopies.keep_one(spark.createDataFrame(planted(), "doc_id long, text string"))
    deadline = time.time() + 10  # they are removed in the background
    while _shuffle_files(spark) - before and time.time() < deadline:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(shared.CLEANUP) == "false"
    assert kept.count()


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for f in glob.glob(f"{top}/**/shuffle_*", recursive=True)}


def test_only_keys_and_nodes_meet_to_make_lists(spark, tmp_path, monkeypatch):
    plans = {}

    def held(df, path):
        plans[path.rpartition("/")[2]] = df._jdf.queryExecution().optimizedPlan().toString()
        return shared.written(df, path)

    monkeypatch.setattr(nearcopies, "written", held)
    rows = [(1, 9, [5, 6, 7], *range(4)), (2, 9, [5, 8], *range(4)), (3, 9, [6, 5], *range(4)), (4, 9, [], *range(4))]
    nodes = spark.createDataFrame(rows, "node long, n int, prefix array<long>, s0 long, s1 long, s2 long, s3 long")
    posts = nearcopies._posts(nodes, str(tmp_path)).collect()
    assert sorted((r.key, r.node, r._many, r.part, r.n, r.s3) for r in posts) == [(5, 1, 3, 0, 9, 3), (5, 2, 3, 0, 9, 3), (5, 3, 3, 0, 9, 3), (6, 1, 2, 0, 9, 3), (6, 3, 2, 0, 9, 3)]
    exploded = [line for line in plans["posts"].splitlines() + plans["keys"].splitlines() if "Generate explode" in line]
    assert len(exploded) == 2
    below = [plan.split("Generate explode")[1].splitlines()[1] for plan in (plans["posts"], plans["keys"])]
    assert all("prefix" in line and "s0" not in line for line in below), below


def test_lists_of_two_are_done_after_the_star(spark):
    mixed = spark.createDataFrame([(1, 2), (2, 3), (3, 900)], "key long, _many long")
    assert sorted(r.key for r in nearcopies._unsettled(mixed).collect()) == [2, 3]


def test_texts_are_picked_where_they_lie(spark, monkeypatch):
    plans = {}

    def held(df, path):
        plans.setdefault(path.rpartition("/")[2], []).append(df._jdf.queryExecution().executedPlan().toString())
        return shared.written(df, path)

    monkeypatch.setattr(nearcopies, "written", held)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where ids are too many to broadcast
    try:
        kept = nearcopies.keep_one(spark.createDataFrame([(1, "a b c d"), (2, "A b c d"), (3, "x y")], "doc_id long, text string"))
        last = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in (last, *plans["texts"], *plans["known"]):
        above = plan[: plan.index("FileScan")]  # rows come first, the picked numbers after them
        assert "Exchange" not in above and "LeftSemi" in above, plan


def test_rows_are_picked_by_number(spark, tmp_path):
    df = spark.range(0, 70_000, 1, 3).selectExpr("id", "cast(id as string) as _of", "id * 2 as _bits")
    rows = shared.in_parts(shared.numbered(spark.range(0, 120_000, 1, 2).join(df.limit(0), "id", "left"), "_row", "_part").coalesce(1), f"{tmp_path}/rows", "_part")
    wanted = lambda k: k % 3 == 1 or k < 20 or 32_760 < k < 32_780
    ids = shared.written(rows.where("id % 3 = 1 or id < 20 or id between 32761 and 32779").select("_row"), f"{tmp_path}/ids")
    found = shared.picked(rows, ids.unionByName(ids), "_row", "_part")
    assert found.columns == rows.columns
    assert sorted(r.id for r in found.select("id").collect()) == [k for k in range(120_000) if wanted(k)]
    assert shared.picked(rows, ids.limit(0), "_row", "_part").count() == 0
