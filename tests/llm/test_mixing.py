"""Apportionment against lists of quotients, and the mix against its quotas piece by piece."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marrow.llm import mixing
from marrow.llm.queries import op12_mixing


def by_lists(targets, limits, seats):
    quotients = sorted((-t / (2 * k + 1), i, k) for i, t in enumerate(targets) if t > 0 for k in range(limits[i]))
    won = Counter(i for _, i, _ in quotients[:seats])
    return [won[i] for i in range(len(targets))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(0, 40).map(float), st.floats(0, 1e6)), st.integers(0, 60)), max_size=8), st.integers(0, 200))
def test_seats_go_by_highest_quotients(sources, seats):
    targets, limits = [s[0] for s in sources], [s[1] for s in sources]
    assert mixing.apportion(targets, limits, seats) == by_lists(targets, limits, seats)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_fill_sources_by_weight(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    found = mixing.targets(sizes, weights, 1.5 * sum(sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))
    level = {t / w for t, w, n in zip(found, weights, sizes) if t < 2 * n}
    for t, w, n in zip(found, weights, sizes):
        assert t <= 2 * n
        if level:  # those that aren't full stand at one level, the full ones below it
            assert t / w == pytest.approx(max(level)) or (t == 2 * n and t / w <= max(level) * (1 + 1e-9))


def checked(rows, mixed, passes=2):
    """Every property of the mix, from its documents' texts."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixed.collect()
    assert sorted((r.doc_id, r.source, r.size) for r in out) == sorted((i, s, words(t)) for i, t, s in rows) if all(s for _, _, s in rows) else True
    totals = Counter()
    for i, t, s in rows:
        totals[s] += words(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    want = mixing.targets([totals[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(totals.values()))
    taken = Counter()
    for r in out:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[order.index(r.source)])
        assert 0 <= r.taken <= passes * r.size
        taken[r.source] += r.taken
    for s, t in zip(order, want):
        assert abs(taken[s] - t) <= max(2 * out[0].block_words, 0.01 * t)
    got = mixing.pieces(mixed).collect()
    by_doc, seats = Counter(), {}
    for p in got:
        by_doc[p.doc_id] += p.words
        seats.setdefault((p.source, p.shard), set()).add(p.seat)
    assert {k: v for k, v in by_doc.items() if v} == {r.doc_id: r.taken for r in out if r.taken}
    # A shard holds its quota of each source, and shards are as large as each other but for one seat.
    quotas = {r.source: r.seats for r in out if r.size}
    for source, upto in quotas.items():
        for shard in range(len(upto)):
            assert len(seats.get((source, shard), ())) == upto[shard] - (upto[shard - 1] if shard else 0)
    sizes = [sum(len(v) for (_, j), v in seats.items() if j == shard) for shard in range(16)]
    assert max(sizes) - min(sizes) <= 1
    return out


def test_mix_of_a_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    first = checked(rows, mixing.mix(docs))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in first) == sorted((r.doc_id, r.taken) for r in again)
    other = mixing.mix(docs, seed=1).collect()
    assert sorted((r.doc_id, r.taken) for r in first) != sorted((r.doc_id, r.taken) for r in other)
    assert sorted(op12_mixing(spark, "/root/testdata/sf0.001").columns) == ["doc_id", "size", "source_size", "taken", "target"]


def test_one_source_of_most_rows_null_sources_and_long_texts(spark):
    rows = [(i, "w " * (i % 50), "hot") for i in range(600)] + [(1000 + i, "a\tb\x0bc d\n" * (i % 9), None) for i in range(100)]
    rows += [(2000, "x " * 70_000, "long"), (2001, "", "long"), (2002, None, "none"), (2003, "one", "tiny"), (2004, "  \n\t", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = checked(rows, mixing.mix(df))
    assert {r.taken for r in out if r.source == "none"} == {0} and {r.target for r in out if r.source == "none"} == {0.0}
    hot = [r for r in out if r.source == "hot" and r.size]
    assert all(r.taken == 2 * r.size for r in hot) == (hot[0].target == 2 * hot[0].source_size)


def test_repeated_rows_empty_tables_and_other_columns(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (None, "a b", "s"), (2, "g h i j", "t")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, taken int")
    out = mixing.mix(df).collect()
    assert len(out) == 4 and sum(r.taken for r in out if r.source == "s") == pytest.approx([r.target for r in out if r.source == "s"][0], abs=2)
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")).collect()] == [0]


def test_ranks_do_not_overflow(spark):
    n = (1 << 40) - 1
    factor, shift = mixing._order_of("k", n, 0)
    blocks = [0, 1, n - 1, n // 2, 123_456_789_012]
    df = spark.createDataFrame([(b, n, factor, shift) for b in blocks], "b long, blocks long, factor long, shift long")
    assert [r[0] for r in df.select(mixing._rank(df.b)).collect()] == [(factor * b + shift) % n for b in blocks]
