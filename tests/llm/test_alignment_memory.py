"""A block's texts are laid out some at a time, and what they hold of the block's pairs is a small blob between steps."""

import tracemalloc
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from marrow.llm import alignment

SPEC, MODEL = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def texts():
    words = "the cat sat upon a windy hill's 12345 naïve doorstep of extraordinarily unbelievable configurations".split()
    rng = np.random.default_rng(0)
    return [" ".join(words[i] for i in rng.integers(0, len(words), 500)) for _ in range(700)]


def test_layout_of_a_block_is_bounded(texts):
    aligner, block = alignment.Aligner(SPEC, MODEL), pa.array(texts, pa.large_string())
    aligner.block(block[:2])
    tracemalloc.start()
    try:
        aligner.block(block)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 14 * block.nbytes  # 20 times where all of a block's texts were laid out together


def test_blocks_are_small_between_steps(spark, texts, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    blocks = alignment.align(df, SPEC, MODEL, str(tmp_path / "b"))
    row = blocks.first()
    lists = [c for c in blocks.columns if isinstance(row[c], list)]
    held = sum(len(row[c]) for c in blocks.columns if isinstance(row[c], (bytes, bytearray))) + 8 * sum(len(row[c]) for c in lists)
    # Places and counts of 8 bytes a piece were the bulk of a row.
    assert row["ends"][-1] > 20 * len(texts) and held < 8 * row["ends"][-1]


def test_pieces_of_any_size_give_the_same(texts, monkeypatch):
    block = pa.array([None, "", *texts[:40], "", "a\n b", "  ", "word" * 3000, None], pa.large_string())
    aligner = alignment.Aligner(SPEC, MODEL)
    want = aligner.block(block)
    for items in (1, 700, 5000):
        monkeypatch.setattr(alignment, "PIECE_ITEMS", items)
        got = aligner.block(block)
        assert all(list(got[c]) == list(want[c]) for c in want)
    assert len(aligner.block(pa.array([], pa.large_string()))["ends"]) == 0


@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(1, 2**32 - 1))))
def test_packed_again(rows):
    place, count = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), ())))
    got = alignment.unpacked(alignment.packed(place, count), len(rows))
    assert got[0].tolist() == place.tolist() and got[1].tolist() == count.tolist()
