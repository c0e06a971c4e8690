"""Word-end BPE ids of whole texts, for the operators that pack or store them.

The tokenizer composes, lower-cases, drops white space and merges inside pre-tokens only, so a text's
ids are those of its blank-separated words one after another, and a word's those of its pre-tokens. Arrow
splits a slice of texts into words, numbers the distinct ones, and cuts letters from the mark after them;
other words are cut one by one. Only pre-tokens that a worker has not seen before reach the tokenizers
library. Words with characters whose composition or case might differ from the library's, and the strings
of added tokens, go to the library whole. The cache is bounded and holds results only, so its size never
changes what comes out.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

END_ID = 2
#: Pre-tokens and ids that a Python worker keeps; the cache starts again when one is full.
CACHE_PIECES, CACHE_IDS = 300_000, 3_000_000
#: Longer ones are encoded but not found again.
CACHE_WORD_CHARS = 64
#: Fixed value: the tokenizer's pattern of pre-tokens.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Printable ASCII, and characters that composing leaves alone and that have one lower-case form: Latin-1
#: letters, the French ligature, dashes, quotation marks and the euro sign.
PLAIN = regex.compile(r"[\x21-\x7E\u00C0-\u00FF\u0152\u0153\u2010-\u2027\u20AC]*")
#: Letters of PLAIN, and at most one mark after them.
LETTERS = "^(?P<body>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u0152\u0153]+)(?P<tail>[.,!?;:]?)$"
LENGTH_BITS = 27
LENGTH_MASK = (1 << LENGTH_BITS) - 1
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 2_000_000


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(maxsize=2)
def _coder(spec: str) -> "WordCoder":
    return WordCoder(spec)


class WordCoder:
    """spec: the tokenizer's JSON, whose pre-tokens are those of PRE_TOKENS."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        # For pre-tokens in lower case: the same model without the steps that would leave them as they are.
        plain = json.loads(spec)
        plain["normalizer"], plain["pre_tokenizer"] = None, plain["pre_tokenizer"]["pretokenizers"][-1]
        self.model = Tokenizer.from_str(json.dumps(plain))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        # Unit -> start and length in ids.
        self.pieces: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _keep(self, ids: np.ndarray) -> int:
        """Appends ids to the store; where they start."""
        start = self.used
        if start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[start : start + len(ids)] = ids
        self.used += len(ids)
        return start

    def _encoded_pieces(self, pieces: list[str]) -> dict[str, int]:
        out = {}
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            e = self.model.encode(part, is_pretokenized=True, add_special_tokens=False)
            lengths = np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))
            starts = self._keep(np.array(e.ids, np.uint32)) + np.cumsum(lengths) - lengths
            out.update(zip(part, (starts << LENGTH_BITS | lengths).tolist()))
        return out

    def _gathered(self, places: np.ndarray) -> np.ndarray:
        starts, lengths = places >> LENGTH_BITS, places & LENGTH_MASK
        at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self.ids[at]

    def _cut(self, word: str) -> list[str] | None:
        """The word's pre-tokens; None if the library has to cut it."""
        if PLAIN.fullmatch(word) and not ("<|" in word and any(a in word for a in self.added)):
            return PRE_TOKENS.findall(word.lower())
        return None

    def _units(self, words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """What the words consist of: units, the words' units in a row as indexes, and how many each word has.

        A unit is a pre-token, or a word that the library has to cut, marked by a blank before it. Letters with at most one
        mark after them, which most words are, are cut in Arrow.
        """
        found = pc.extract_regex(words, LETTERS)
        simple = pc.is_valid(found).to_numpy(zero_copy_only=False)
        body, tail = (pc.struct_field(found, name).filter(pa.array(simple)) for name in ("body", "tail"))
        body, marked = pc.utf8_lower(body).dictionary_encode(), pc.not_equal(tail, "").to_numpy(zero_copy_only=False)
        tail = tail.filter(pa.array(marked)).dictionary_encode()
        rest = _strings(words.filter(pa.array(~simple)))
        cut = [ps if ps is not None else [" " + w] for w, ps in zip(rest, map(self._cut, rest))]
        others = {u: i for i, u in enumerate(dict.fromkeys(u for ps in cut for u in ps))}
        units = _strings(body.dictionary) + _strings(tail.dictionary) + list(others)
        counts = np.ones(len(words), np.int64)
        places = np.flatnonzero(simple)
        counts[places[marked]] = 2
        counts[~simple] = [len(ps) for ps in cut]
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        first = len(body.dictionary) + len(tail.dictionary)
        flat[np.repeat(~simple, counts)] = np.array([others[u] for ps in cut for u in ps], np.int64) + first
        flat[starts[places]] = body.indices.to_numpy()
        flat[starts[places[marked]] + 1] = tail.indices.to_numpy() + len(body.dictionary)
        return units, flat, counts

    def _places(self, units: list[str]) -> np.ndarray:
        if len(self.pieces) > CACHE_PIECES or self.used > CACHE_IDS:
            self.clear()
        places = list(map(self.pieces.get, units))
        new = list(dict.fromkeys(u for u, p in zip(units, places) if p is None))
        if new:
            whole = [u for u in new if u[0] == " "]
            learned = self._encoded_pieces([u for u in new if u[0] != " "] if whole else new)
            for u, e in zip(whole, self.tokenizer.encode_batch([u[1:] for u in whole], add_special_tokens=False) if whole else []):
                learned[u] = self._keep(np.array(e.ids, np.uint32)) << LENGTH_BITS | len(e.ids)
            places = [learned[u] if p is None else p for u, p in zip(units, places)]
            self.pieces.update(learned if max(map(len, new)) <= CACHE_WORD_CHARS else {u: p for u, p in learned.items() if len(u) <= CACHE_WORD_CHARS})
        return np.array(places, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end. A null text has none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        word_ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        # The distinct words' ids as one list array, of which Arrow then takes every word's.
        units, flat, counts = self._units(coded.dictionary)
        places = self._places(units)[flat]
        upto = np.concatenate([[0], np.cumsum(places & LENGTH_MASK)])[np.concatenate([[0], np.cumsum(counts)])]
        taken = pa.LargeListArray.from_arrays(pa.array(upto.astype(np.int64)), pa.array(self._gathered(places))).take(coded.indices)
        first = taken.offsets[0].as_py()
        ids = taken.values.to_numpy()[first : taken.offsets[-1].as_py()]
        return ids, (taken.offsets.to_numpy() - first)[np.concatenate([[0], word_ends])][1:]


def encoded(spec: str, texts: pa.Array, end_id: int = END_ID):
    """Yields each text's ids, end_id appended, as uint32; works through the texts in slices of bounded size."""
    coder = _coder(spec)
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held + sizes[upto] <= SLICE_BYTES):
            held += sizes[upto]
            upto += 1
        ids, ends = coder.encode(texts.slice(at, upto - at))
        begin = 0
        for end in ends:
            yield np.append(ids[begin:end], np.uint32(end_id))
            begin = end
        at = upto
