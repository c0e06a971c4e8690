"""WARC archive, line dedup and sharding: odd inputs and properties, against brute force."""

import hashlib
import random
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marrow.llm import lines, sharding, warc
from marrow.llm.queries import op7_sharding

LONG = "x" * 120


def test_archive_round_trip(spark, tmp_path):
    rows = [(5, "http://a b/\r\nX: y", LONG), (3, None, LONG), (3, None, LONG), (None, "u", LONG), (7, "u", "short"), (8, "u", "short"), (9, "u", None), (None, "v", LONG + "é"), (10, "v", LONG + "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archive = warc.write_archive(pages, f"{tmp_path}/w")
    assert spark.read.parquet(archive.payloads).count() == len({(r[2] or "") for r in rows})
    records = warc.read_records(spark, archive).collect()
    assert len(records) == len(rows)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    e = LONG + "é"
    want = Counter([(3, 120, sha(LONG), "response", None), (3, 120, sha(LONG), "revisit", 3), (5, 120, sha(LONG), "revisit", 3), (None, 120, sha(LONG), "revisit", 3), (7, 5, sha("short"), "response", None), (8, 5, sha("short"), "response", None), (9, 0, sha(""), "response", None), (10, 122, sha(e), "response", None), (None, 122, sha(e), "revisit", 10)])
    assert got == want
    for r in warc.reconstruct(spark, archive).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and fields["WARC-Record-ID"] == r.record_id
        block = rest[: -4]
        assert rest.endswith(b"\r\n\r\n") and len(block) == int(fields["Content-Length"])
        body = block.partition(b"\r\n\r\n")[2]
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(body).hexdigest() == fields["WARC-Payload-Digest"]
        else:
            assert body == b"" and "WARC-Refers-To" in fields
    empty = warc.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_records(spark, empty).count() == 0


def test_archive_refuses_a_changed_payload(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string"), f"{tmp_path}/w")
    spark.read.parquet(archive.payloads).withColumn("payload", F.encode(F.lit("other"), "UTF-8")).write.parquet(f"{tmp_path}/w2/payloads")
    spark.read.parquet(archive.headers).write.parquet(f"{tmp_path}/w2/headers")
    with pytest.raises(Exception, match="digest"):
        warc.read_records(spark, warc.Archive(f"{tmp_path}/w2")).collect()


def brute_lines(docs, min_docs):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                seen.setdefault(k, []).append(i)
    out = []
    for i, text in docs:
        all_lines = (text or "").split("\n")

        def gone(line):
            ids = seen.get(key(line), [])
            best = max((x for x in ids if x is not None), default=None)
            return len(ids) >= min_docs and best is not None and i != best

        kept = [x for x in all_lines if not gone(x)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("fanout", [2, 4])
def test_line_dedup_against_brute_force(spark, monkeypatch, fanout):
    rng = random.Random(fanout)
    pool = [f"Common LINE number {i} that is surely long enough" for i in range(12)] + ["short", "", "É" * 40, "é" * 39]
    docs = [(i, "\n".join(rng.choice(["", " ", "\t\x0b"]) + rng.choice(pool) + rng.choice(["", "\r", f" own {i}"]) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    docs += [(None, pool[0]), (60, None), (61, ""), (59, pool[1] + "\n" + pool[1]), (62, "\n\n"), (62, "z" * 200_000)]
    monkeypatch.setattr(lines.LineRuns.__init__, "__defaults__", (fanout,))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hash", F.lit("clash"))
    for batches in (1, 5):
        out = lines.dedup_lines(df, batches=batches)
        assert Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in out.collect()) == brute_lines(docs, 5)
        assert "hash" in out.columns
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_runs_are_compacted_and_anti_joined(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path), fanout=2)
    for doc in (9, 8, 7, 6, 5):
        runs.add(spark.createDataFrame([(doc, b"a"), (doc, bytes([doc]))], "doc_id long, hash binary"))
    assert sum(map(len, runs.levels)) <= 3 and len(runs.levels) >= 3
    assert runs.rows().where("keeper IS NOT NULL").groupBy("hash").count().where("count > 1").isEmpty()
    assert [tuple(r) for r in runs.repeated(5).collect()] == [(b"a", 9)]


def check_shards(rows, docs, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_of_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check_shards(op7_sharding(spark, "/root/testdata/sf0.001").collect(), docs)


def test_sharding_keeps_groups_together_and_splits_hot_ones(spark):
    docs = [(i, "hot") for i in range(200)] + [(i, f"pair {i // 2}") for i in range(200, 300)] + [(i, f"lone {i}") for i in range(300, 590)] + [(None, None), (None, ""), (5, "hot")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    rows = sharding.shard_rows(df).collect()
    check_shards(rows, docs)
    places = {}
    for r in rows:
        places.setdefault(bytes(r.grp), []).append(r.shard)
    together = sum(len(set(v)) == 1 for v in places.values() if len(v) == 2)
    assert together >= 0.9 * sum(len(v) == 2 for v in places.values())
    hot = max(places.values(), key=len)
    assert len(set(hot)) <= 9  # 201 rows, shards of 37 or 38
    check_shards(sharding.shard_rows(df.limit(3)).collect(), docs[:3])
    assert sharding.shard_rows(df.limit(0)).count() == 0


def test_all_rows_linked(spark):
    docs = [(i, f"group {i % 32}") for i in range(331)]
    rows = sharding.shard_rows(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_shards(rows, docs)


def test_flows_respect_capacity():
    rng = random.Random(0)
    for _ in range(200):
        k = rng.randint(2, 6)
        load = [rng.randint(0, 30) for _ in range(k)]
        capacity = [x + rng.choice([0, 0, 5]) for x in load]
        wish = [[0 if s == t else rng.randint(0, max(0, load[s] // (k - 1))) for t in range(k)] for s in range(k)]
        flow = sharding.allowed_flows(load, capacity, wish)
        for t in range(k):
            assert load[t] + sum(flow[s][t] for s in range(k)) - sum(flow[t]) <= capacity[t]
            assert all(0 <= flow[s][t] <= wish[s][t] for s in range(k))


def test_group_of_most_rows_gathers(spark):
    """Sixty per cent of the rows are alike: sizes stay even, and more links lie within shards than rows dealt evenly keep."""
    docs = [(i, "the same") for i in range(600)] + [(1000 + i, f"text {i % 150}") for i in range(300)] + [(2000 + i, f"single {i}") for i in range(100)] + [(None, "the same")] * 3

    def kept(rounds):
        rows = sharding.shard_rows(spark.createDataFrame(docs, "doc_id long, text string"), rounds=rounds).collect()
        check_shards(rows, docs)
        places = {}
        for r in rows:
            places.setdefault(bytes(r.grp), Counter())[r.shard] += 1
        pairs = [c for c in places.values() if sum(c.values()) == 2]
        return sum(n * (n - 1) // 2 for c in places.values() for n in c.values()), sum(len(c) == 1 for c in pairs) / len(pairs)

    (before, _), (after, whole) = kept(0), kept(None)
    assert after > 1.1 * before and whole >= 0.9


def test_line_dedup_of_documents_with_very_many_repeated_lines_is_linear(spark):
    body = "\n".join(f"a line that is long enough to be looked at, number {i}" for i in range(100_000))
    df = spark.createDataFrame([(i, body) for i in range(6)], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: (r._n_lines, r._n_dropped, r._kept) for r in lines.dedup_lines(df).collect()}
    assert time.monotonic() - start < 120  # a lookup of every line in every lost line takes half an hour
    assert got == {**{i: (100_000, 100_000, "") for i in range(5)}, 5: (100_000, 0, body)}


def test_line_dedup_batches_follow_rows_not_the_range_of_ids(spark, monkeypatch):
    sizes, add = [], lines.LineRuns.add
    monkeypatch.setattr(lines.LineRuns, "add", lambda self, rows: (sizes.append(rows.count()), add(self, rows)))
    docs = [(i, f"a line of document {i} that nothing else holds at all\n" + "x" * 50) for i in range(400)] + [(2**62, "x" * 50), (None, "y\n" + "X" * 50), (None, "x" * 50 + " ")]
    out = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), batches=4)
    assert Counter((r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in out.collect()) == brute_lines(docs, 5)
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
