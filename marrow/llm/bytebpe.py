"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every token's bytes are mapped to printable characters, one each, and become a piece whose score is its
negative rank, so the library merges in rank order and a piece's id is its rank. The model's normaliser
is the identity. A text is cut by the vocabulary's pattern, each pre-token is encoded on its own (a
pre-token that is itself in the vocabulary is that one id), and ids are decoded by the inverse mapping.

Defined cases: a null or empty text has no ids; repeated and null doc_ids are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a Python worker keeps; the cache starts again when it is full.
CACHE_WORDS = 300_000
CACHE_WORD_CHARS = 64
#: The pre-tokens of longer texts are taken one at a time.
LONG_TEXT_CHARS = 1_000_000
SCHEMA = "doc_id long, ids binary, n_tokens long"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def read_ranks(lines: bytes) -> list[bytes]:
    """The tokens of a rank file, in rank order; ranks must run from 0 without gaps."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialized_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto; the piece after the last rank is the unknown one, which no text reaches."""
    # Fixed values of the public message format: field numbers, piece and model types.
    pieces, trainer, normalizer = 1, 2, 3
    piece, score, kind = 1, 2, 3
    unknown, bpe = 2, 2
    model_type, vocab_size, unk_id, bos_id, eos_id, pad_id = 3, 4, 40, 41, 42, 43
    name, add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = 1, 3, 4, 5

    letters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(tokens):
        text = "".join(letters[b] for b in token).encode()
        out += _bytes(pieces, _bytes(piece, text) + _varint(score << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _bytes(pieces, _bytes(piece, b"<unk>") + _varint(score << 3 | 5) + struct.pack("<f", 0.0) + _number(kind, unknown))
    absent = (1 << 64) - 1  # -1 as a varint
    out += _bytes(trainer, _number(model_type, bpe) + _number(vocab_size, len(tokens) + 1) + _number(unk_id, len(tokens)) + _number(bos_id, absent) + _number(eos_id, absent) + _number(pad_id, absent))
    out += _bytes(normalizer, _bytes(name, b"identity") + _number(add_dummy_prefix, 0) + _number(remove_extra_whitespaces, 0) + _number(escape_whitespaces, 0))
    return bytes(out)


class ByteCoder:
    """Encodes and decodes with the model that serialized_model() makes of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.tokens = read_ranks(ranks)
        self.known = {t: i for i, t in enumerate(self.tokens)}
        self.letters = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialized_model(self.tokens))
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}
        # For decoding: all tokens' bytes in a row, with each one's start and length.
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _pre_token(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.known.get(raw)
        ids = [whole] if whole is not None else self.model.encode(raw.decode("latin-1").translate(self.letters), num_threads=1)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        cache, other = self.cache, self._pre_token
        words = self.pattern.findall(text) if len(text) < LONG_TEXT_CHARS else (m.group() for m in self.pattern.finditer(text))
        return b"".join([cache.get(word) or other(word) for word in words])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - lengths), lengths)].tobytes()


@lru_cache(maxsize=2)
def _coder(ranks: bytes, pattern: str) -> ByteCoder:
    return ByteCoder(ranks, pattern)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), n_tokens. ranks: the content of a rank file."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            ids = [coder.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(coded, SCHEMA)


def decode(coded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """Adds decoded (binary) to rows of encode()."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            decoded = [coder.decode(np.frombuffer(x.as_py(), "<u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "n_tokens", "decoded"])

    return coded.select("doc_id", "ids", "n_tokens").mapInArrow(plain, SCHEMA + ", decoded binary")
