"""Operators that tokenize: checked against the tokenizers and tiktoken libraries on whole texts."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marrow.llm import bytebpe, packing, tokenfiles
from marrow.llm.queries import op4_byte_bpe, op6_packing, op9_token_files, word_tokenizer

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n  \t", "a", "it's I'LL", "café café ́x", "x y z \u0085", "你好 \U0001f600\U0001f468‍\U0001f469", "<|endoftext|> a<|startoftext|>b", "AbC" * 3000, "word " * 9000, "  lead   and\n\n trail  ", "İΣσς ẞ"]


def reference_ids(texts):
    t = Tokenizer.from_str(word_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))


def check_packing(rows, wanted):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(wanted)
    for doc, pieces in by_doc.items():
        ids, at = wanted[doc], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding <= 0.02 * sum(map(len, wanted.values()))


def test_packing_of_documents(spark):
    docs = documents()
    check_packing(op6_packing(spark, SF).collect(), dict(zip([d["doc_id"] for d in docs], reference_ids([d["text"] for d in docs]))))


def test_packing_of_odd_texts(spark):
    check_packing(packing.pack(odd(spark), word_tokenizer(), group=3).collect(), dict(enumerate(reference_ids(ODD))))
    assert packing.pack(odd(spark).limit(0), word_tokenizer()).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = [6, 5, 5, 4, 3, 2, 1]
    windows = packing.best_fit_decreasing(lengths, 10)
    assert sorted(i for w in windows for i in w) == list(range(7))
    assert [sorted(lengths[i] for i in w) for w in windows] == [[4, 6], [5, 5], [1, 2, 3]]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 101, 500).tolist()
    expected, room = [], []
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        fits = [(room[w], w) for w in range(len(room)) if room[w] >= lengths[i]]
        if not fits:
            room.append(100)
            fits = [(100, len(room) - 1)]
        room[min(fits)[1]] -= lengths[i]
    windows = packing.best_fit_decreasing(lengths, 100)
    assert len(windows) == len(room)
    assert all(sum(lengths[i] for i in w) <= 100 for w in windows)


def check_files(rows, docs):
    before = 0
    for r, (doc, ids) in zip(sorted(rows, key=lambda r: r.start), docs, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, before, len(ids), crc(ids))
        before += len(ids)


def test_token_files_of_documents(spark):
    docs = sorted(documents(), key=lambda d: d["doc_id"])
    check_files(op9_token_files(spark, SF).collect(), list(zip([d["doc_id"] for d in docs], reference_ids([d["text"] for d in docs]))))


def test_token_files_of_odd_texts(spark, tmp_path):
    for name, size in (("a", 1), ("b", 4_000_000)):
        tokenfiles.write_token_files(odd(spark), word_tokenizer(), f"{tmp_path}/{name}", file_bytes=size)
        rows = tokenfiles.read_documents(spark, f"{tmp_path}/{name}").withColumn("ids_crc32", F.crc32("ids")).collect()
        check_files(rows, list(enumerate(reference_ids(ODD))))
    tokenfiles.write_token_files(odd(spark).limit(0), word_tokenizer(), f"{tmp_path}/c")
    assert tokenfiles.read_documents(spark, f"{tmp_path}/c").count() == 0


def test_token_files_with_repeated_and_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (1, "zz"), (0, None)], "doc_id long, text string")
    tokenfiles.write_token_files(docs, word_tokenizer(), f"{tmp_path}/x")
    rows = sorted(tokenfiles.read_documents(spark, f"{tmp_path}/x").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 1, 1]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(5)]


def test_one_document_is_read_alone():
    codecs = tokenfiles._codecs(b"")
    arrays = [np.arange(n, dtype=np.uint32) for n in (3, 0, 500)]
    digest = hashlib.sha256(b"").digest()
    content = tokenfiles.pack_file([codecs[0].compress(tokenfiles.serialized(a, 2)) for a in arrays], [len(a) for a in arrays], 2, digest)
    file = tokenfiles.TokenFile(content, {digest: b""})
    assert [file.ids(i).tolist() for i in (2, 0, 1)] == [arrays[i].tolist() for i in (2, 0, 1)]


def own_encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return open(path, "rb").read(), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_of_documents(spark):
    _, library = own_encoding()
    rows = {r.doc_id: r for r in op4_byte_bpe(spark, SF).collect()}
    docs = documents()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d["text"])
        r = rows[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d["text"].encode()).hexdigest()


def test_byte_bpe_of_odd_texts(spark):
    ranks, library = own_encoding()
    docs = odd(spark)
    rows = bytebpe.decode(bytebpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bytebpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_ids_beyond_the_width_are_an_error():
    with pytest.raises(ValueError):
        tokenfiles.serialized(np.array([1, 70_000], np.uint32), 2)
    assert tokenfiles.serialized(np.array([1, 65_535], np.uint32), 2) == b"\x01\x00\xff\xff"
