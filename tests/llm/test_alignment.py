"""Alignment against byte offsets of both tokenizers' whole encodings."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marrow.llm import alignment
from marrow.llm.queries import op13_alignment

SPEC, MODEL = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_str(SPEC)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    chars = alignment.byte_level_alphabet()
    assert sorted(chars.values()) == list(range(256)) and chars["Ġ"] == 0x20 and chars["Ċ"] == 0x0A
    a_bytes = {i: bytes(map(chars.__getitem__, t)) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(3, b.get_piece_size())}
    return a, b, a_bytes, b_bytes


def brute(texts, sides):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each text, by ends of tokens."""
    a_side, b_side, a_bytes, b_bytes = sides
    found, counts = [], Counter()
    for t in texts:
        a = a_side.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes.get(i, b"") for i in a) != raw or b"".join(b_bytes.get(i, b"") for i in b) != raw:
            found.append(None)
            continue
        ea, eb = (list(accumulate(len(m[i]) for i in ids)) for ids, m in ((a, a_bytes), (b, b_bytes)))
        links = []
        j = 0
        for i, end in enumerate(ea):
            start = ea[i - 1] if i else 0
            while j and (eb[j - 1] > start):
                j -= 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < end:
                if eb[k] > start:
                    links.append((a[i], b[k]))
                k += 1
            j = max(k - 1, 0)
        both, shown, ia, ib = sorted(set(ea) & set(eb)), [], 0, 0
        for end in both:
            na, nb = ea.index(end, ia) + 1, eb.index(end, ib) + 1
            shown.append(",".join(map(str, a[ia:na])) + "|" + ",".join(map(str, b[ib:nb])))
            ia, ib = na, nb
        found.append((len(a), len(b), len(both), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
        counts.update(links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n, links, sha = f
            out.append((n_a, n_b, n, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


ODD = [None, "", " ", "  ", "a", " a ", "a  b", "a\n b", "a\n  b\t c \n\n d", "▁", "x ▁y", "<|endoftext|> <s> </s> <unk> <0x41>", "café naïve 你好 \U0001f600 é", "\x00 nul \x07", "it's we'll 12345 ...!!!", " no break  em", "a  b", "word" * 5000, "� ﻿bom", "\r\n\r\n x", "a 　 b", " ؀"]


def test_odd_texts(spark, sides, monkeypatch):
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(ODD * 2)] + [(None, "a b", 1, "z")], "doc_id long, text string, n_a int, place string")
    want = [(i, *w) for i, w in enumerate(brute(ODD * 2 + ["a b"], sides))]
    want[-1] = (None, *want[-1][1:])
    assert rows_of(alignment.align_tokens(df, SPEC, MODEL)) == sorted(want, key=str)
    assert alignment.align_tokens(df.limit(0), SPEC, MODEL).count() == 0


def test_documents_in_small_blocks(spark, sides, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((d.doc_id, *w) for d, w in zip(docs, brute([d.text for d in docs], sides))), key=str)
    assert rows_of(op13_alignment(spark, "/root/testdata/sf0.001")) == want
    aligner = alignment.Aligner(SPEC, MODEL)
    import pyarrow as pa

    monkeypatch.setattr(alignment, "CACHE_STEPS", 20)
    small = [aligner.block(pa.array([d.text for d in docs[i : i + 7]], pa.large_string())) for i in range(0, 70, 7)]
    assert [x for b in small for x in b["n_groups"].tolist()] == [w[3] for w in sorted(want)[:70]]


def test_alignment_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the")], "doc_id long, text string")
    blocks = alignment.align(df, SPEC, MODEL, str(tmp_path / "b"))
    rows = {(r.a, r.b): (r.links, r.best) for r in alignment.table(alignment.pair_counts(blocks)).collect()}
    a, b = Tokenizer.from_str(SPEC).encode(" the").ids[0], sentencepiece.SentencePieceProcessor(model_proto=MODEL).encode("the")[0]
    assert rows[a, b] == (3, True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=4), st.data(), st.sampled_from([0, 16]))
def test_transducer_on_random_cuts(raws, data, few):
    names, ids, spans = ([], []), ([], []), ([], [])
    for raw in raws:
        for side in (0, 1):
            cut = sorted(data.draw(st.sets(st.integers(1, len(raw) - 1))) if len(raw) > 1 else set()) + [len(raw)]
            tokens = [raw[s:e] for s, e in zip([0, *cut], cut)]
            names[side].extend(t for t in tokens if t not in names[side])
            ids[side].append([names[side].index(t) for t in tokens])
            spans[side].append(list(zip([0, *cut], cut)))

    def run(a, b):
        flat = tuple(np.array([t for x in side for t in x]) for side in ids)
        return alignment.Transducer(a, b).groups(flat, tuple(np.cumsum([len(x) for x in side]) for side in ids))

    was, alignment.FEW = alignment.FEW, few
    try:
        good, group, text, pairs = run(*map(list, names))
        bad = run(list(names[0]), [bytes(255 - c for c in t) for t in names[1]])[0]
    finally:
        alignment.FEW = was
    assert good.all() and not bad.any()
    want, groups = [], ([], [])
    for i in range(len(raws)):
        both = sorted({e for _, e in spans[0][i]} & {e for _, e in spans[1][i]})
        want.append(sorted(a << alignment.SHIFT | b for a, (s, e) in zip(ids[0][i], spans[0][i]) for b, (t, f) in zip(ids[1][i], spans[1][i]) if s < f and t < e))
        for side in (0, 1):
            groups[side].extend(sum(m < e for m in both) for _, e in spans[side][i])
    assert [sorted(pairs[text == i].tolist()) for i in range(len(raws))] == want
    assert [g.tolist() for g in group] == list(groups)


def test_chunks_are_encoded_in_a_row(sides, monkeypatch):
    aligner = alignment.Aligner(SPEC, MODEL)
    texts = [f" word{i}" for i in range(3000)] + [" end\n", " ", " \t", " naïve", " x\x1c", " 'tis", " <|endoftext|>", "  two", " \U0001f600!", " don't"] * 2 + [" y" * 20_000, " z"]
    alone = [sides[0].encode(t, add_special_tokens=False).ids for t in texts]
    calls = []

    class Counting:
        def encode(self, text, **options):
            calls.append(text)
            return sides[0].encode(text, **options)

    monkeypatch.setattr(aligner, "a", Counting())
    sizes = np.array([len(t.encode()) for t in texts])
    ids, lengths = aligner._a_ids(texts, sizes)
    assert ids.tolist() == [i for x in alone for i in x] and lengths.tolist() == [len(x) for x in alone]
    assert len(calls) < 40 and max(map(len, calls)) <= alignment.ROW_BYTES + 40_000
    ids, lengths = aligner._a_ids([], np.zeros(0, np.int64))
    assert not len(ids) and not len(lengths)
    # Where tokens' bytes don't end with the texts, each text is encoded by itself.
    monkeypatch.setattr(aligner, "a_sizes", aligner.a_sizes + 1)
    ids, lengths = aligner._a_ids(texts, sizes)
    assert ids.tolist() == [i for x in alone for i in x] and lengths.tolist() == [len(x) for x in alone]
