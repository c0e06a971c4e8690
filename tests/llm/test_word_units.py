"""Word coding for packing and token files: ids equal the library's, and few words are cut outside Arrow."""

from itertools import product

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from marrow.llm import tokens
from marrow.llm.queries import word_tokenizer

ODD = ["", "  \n", None, "İstanbul ẞ Ÿ ÿ K Å Œuvre, ÷ × don't rock'n'roll it's.", "<|endoftext|> a<|x|>b <|", "1a2b 33.5% (foo) «bar» — “q” €5 a.b.c ...", "A" * 200 + ". " + "é" * 90, "a\x00b \x1c z \x85", "Straße! ÄÖÜ? word:;", "é É. ﬁ"]


def test_ids_are_the_librarys_whatever_a_word_is_made_of(monkeypatch):
    texts = ODD + ["".join(p) for p in product(["a", "É", "'", "1", ".", "<|", "ß", " "], repeat=3)]
    whole = Tokenizer.from_str(word_tokenizer())
    want = [[*e.ids, tokens.END_ID] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for pieces, ids in ((tokens.CACHE_PIECES, tokens.CACHE_IDS), (3, 10)):
        monkeypatch.setattr(tokens, "CACHE_PIECES", pieces)
        monkeypatch.setattr(tokens, "CACHE_IDS", ids)
        monkeypatch.setattr(tokens, "SLICE_BYTES", 200)
        assert [x.tolist() for x in tokens.encoded(word_tokenizer(), pa.array(texts, pa.string()))] == want


def test_most_words_are_cut_in_arrow(monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"]
    cut, real = [], tokens.WordCoder._cut
    monkeypatch.setattr(tokens.WordCoder, "_cut", lambda self, word: cut.append(word) or real(self, word))
    coder = tokens.WordCoder(word_tokenizer())
    coder.encode(pa.concat_arrays(texts.cast(pa.large_string()).chunks))
    distinct = len(pc.unique(pc.ascii_split_whitespace(pc.fill_null(texts, "")).combine_chunks().flatten()))
    assert len(cut) < distinct / 4
