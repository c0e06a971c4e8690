"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes. Reading both sequences, the transducer's state is which side leads and the
bytes that the other side hasn't matched yet: always a suffix of the leading side's last token. The side behind
supplies the next token, which is linked to that last token; it shortens the residual, ends it (the group closes)
or takes over the lead. Transitions are memoised by (side, residual, token).

Both tokenizers start anew at a blank that follows a character other than white space, so texts are cut there into chunks and
each distinct chunk of a block of texts goes through tokenizers and transducer once. The transducer takes a step of all chunks at a time,
looking up the distinct transitions. Texts whose chunks don't reproduce their bytes are encoded whole.

Links are counted by pair of ids over the corpus. A block keeps its distinct pairs with their counts, and for each text the
places of its pairs among them. Pairs are summed over blocks, each pair's row goes back to the blocks that hold it, never to
single texts, and a block then adds up its texts. So a frequent pair costs a row a block, and nothing is broadcast.

Memory: a block's texts are laid out some at a time, what its texts hold of its pairs is a compressed blob that only Python opens
(packed()), and workers let go of the tokenizers when they sum texts.

Defined cases: null and empty texts, and those whose joined bytes on either side differ from a blank and the text, have no tokens:
counts are 0 and groups are ''. Rows that repeat a doc_id are texts of their own; a null doc_id stays; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.shared import join_hot, text_or_empty, work_dir, written

#: Bytes of text in a block of texts; longer texts are blocks of their own.
BLOCK_BYTES = 3_000_000
#: Transitions that a Python worker keeps; a full memo starts again.
CACHE_STEPS = 1_000_000
#: About so many bytes of chunks go through the byte-level tokenizer in a row.
ROW_BYTES = 8192
#: About so many items (tokens) of a block's texts are laid out at a time; a longer text is laid out by itself.
PIECE_ITEMS = 200_000
#: So few texts go on one by one.
FEW = 16
#: A pair is a * 2**SHIFT + b.
SHIFT = 32
DEAD = -1
_CUT = regex.compile(r"(?<=\S)(?= )")
_BYTE_PIECE = regex.compile(r"<0x([0-9A-F]{2})>")


class Transducer:
    """a, b: the bytes of each side's tokens, by id; an id without bytes matches nothing.

    A state is a side and its residual, by number; state 0 is the empty residual, 1 + i that of A's token i.
    """

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self.residual = [b"", *a]
        self.lead = [0] * (1 + len(a))
        self.number = {(0, r): i for i, r in reversed(list(enumerate(self.residual)))}
        self.steps: dict[int, int] = {}

    def step(self, key: int) -> int:
        """The state after state key >> 32 meets token key & 0xFFFFFFFF of the side behind; DEAD where bytes differ."""
        state, token = key >> 32, key & 0xFFFFFFFF
        lead, residual = self.lead[state], self.residual[state]
        own = self.bytes[1 - lead][token]
        if not own or not (residual.startswith(own) or own.startswith(residual)):
            found = DEAD
        elif len(own) == len(residual):
            found = 0
        else:
            side, rest = (lead, residual[len(own) :]) if len(own) < len(residual) else (1 - lead, own[len(residual) :])
            found = self.number.setdefault((side, rest), len(self.residual))
            if found == len(self.residual):
                self.residual.append(rest)
                self.lead.append(side)
        if len(self.steps) >= CACHE_STEPS:
            self.steps.clear()
        self.steps[key] = found
        return found

    def groups(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Whether each text's sides spell the same bytes, each token's group within its text, and the links' texts and pairs in order.

        ids: all texts' tokens of each side; ends: where each text's end. All texts take a step together; the last few go on one by one.
        """
        n = len(ends[0])
        at = [np.concatenate([[0], e[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64) for e in ends]
        group = tuple(np.zeros(len(x), np.int64) for x in ids)
        good, closed, state, last = np.ones(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        texts, pairs = [], []
        live = np.arange(n)
        while True:
            done = live[(state[live] == 0) & (at[0][live] == ends[0][live])]
            good[done[at[1][done] < ends[1][done]]] = False
            live = live[good[live] & ((state[live] > 0) | (at[0][live] < ends[0][live]))]
            if len(live) <= FEW:
                break
            new = live[state[live] == 0]
            token = ids[0][at[0][new]]
            group[0][at[0][new]] = closed[new]
            at[0][new] += 1
            state[new], last[new] = token + 1, token
            lead = np.array(self.lead, np.int8)[state[live]]
            token = np.zeros(len(live), np.int64)
            ended = np.zeros(len(live), bool)
            for side in (0, 1):
                own = np.flatnonzero(lead != side)
                ended[own] = at[side][live[own]] == ends[side][live[own]]
                own = own[~ended[own]]
                place = at[side][live[own]]
                token[own], group[side][place] = ids[side][place], closed[live[own]]
                at[side][live[own]] += 1
            good[live[ended]] = False
            live, lead, token = live[~ended], lead[~ended], token[~ended]
            keys, of = np.unique(state[live] << 32 | token, return_inverse=True)
            following = np.array([self.steps[k] if k in self.steps else self.step(k) for k in keys.tolist()], np.int64)[of]
            texts.append(live)
            pairs.append(np.where(lead == 0, last[live] << SHIFT | token, token << SHIFT | last[live]))
            good[live[following == DEAD]] = False
            closed[live] += following == 0
            turned = (following > 0) & (np.array(self.lead, np.int8)[np.maximum(following, 0)] != lead)
            last[live[turned]] = token[turned]
            state[live] = np.maximum(following, 0)
        for i in live.tolist():
            found = self._rest(i, ids, ends, [int(x[i]) for x in at], int(closed[i]), int(state[i]), int(last[i]), group)
            good[i] = found is not None
            texts.append(np.full(len(found or ()), i))
            pairs.append(np.array(found or [], np.int64))
        text = np.concatenate([*texts, np.zeros(0, np.int64)])
        order = np.argsort(text, kind="stable")
        order = order[good[text[order]]]
        return good, group, text[order], np.concatenate([*pairs, np.zeros(0, np.int64)])[order]

    def _rest(self, i: int, ids, ends, at: list[int], closed: int, state: int, last: int, group) -> list[int] | None:
        """The remaining pairs of text i; None where its sides differ."""
        upto, out = [int(e[i]) for e in ends], []
        while state or at[0] < upto[0]:
            if not state:
                last = int(ids[0][at[0]])
                group[0][at[0]] = closed
                at[0] += 1
                state = last + 1
            lead = self.lead[state]
            side = 1 - lead
            if at[side] == upto[side]:
                return None
            token = int(ids[side][at[side]])
            group[side][at[side]] = closed
            at[side] += 1
            out.append(token << SHIFT | last if lead else last << SHIFT | token)
            key = state << 32 | token
            state = self.steps[key] if key in self.steps else self.step(key)
            if state == DEAD:
                return None
            if not state:
                closed += 1
            elif self.lead[state] != lead:
                last = token
        return out if at[1] == upto[1] else None


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others moved up from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of lengths[i] elements each, in a row."""
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    at += np.arange(len(at))
    return at


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _pieces(items: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_ITEMS items; items: each text's."""
    piece = np.cumsum(items) // PIECE_ITEMS
    cuts = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(items)).tolist()
    return zip(cuts, cuts[1:])


def packed(place: np.ndarray, count: np.ndarray) -> bytes:
    """Places and counts of a block's texts: places as differences, both in planes of bytes, compressed."""
    steps = np.diff(place.astype("<u4"), prepend=np.zeros(1, "<u4"))  # wraps around where a text ends
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 4).T, count.astype("<u4").view(np.uint8).reshape(-1, 4).T])
    return pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unpacked(blob: bytes | pa.Buffer, n: int) -> tuple[np.ndarray, np.ndarray]:
    """place and count, n of each, of packed()."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob, 8 * n), np.uint8).reshape(2, 4, n)
    steps, count = (np.ascontiguousarray(x.T).reshape(-1).view("<u4") for x in planes)
    return np.cumsum(steps, dtype="<u4").astype(np.int64), count.astype(np.int64)


class Aligned:
    """Aligned texts: tokens of each side and groups of each, and in a row their items (token and separator) and pairs; none for texts whose bytes differ."""

    def __init__(self, good: np.ndarray, sizes: tuple[np.ndarray, ...], items: np.ndarray, pairs: np.ndarray):
        self.good, self.sizes, self.items, self.pairs = good, sizes, items, pairs
        self.n_items, self.n_pairs = sizes[0] + sizes[1], np.where(good, sizes[0] + sizes[1] - sizes[2], 0)


class Aligner:
    """spec: JSON of the byte-level tokenizer (A); model: the serialised piece model (B)."""

    def __init__(self, spec: str, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        alphabet = byte_level_alphabet()
        a, b = [b""] * self.a.get_vocab_size(), [b""] * self.b.get_piece_size()
        for t, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in t):
                a[i] = bytes(alphabet[c] for c in t)
        for i in range(len(b)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                byte = _BYTE_PIECE.fullmatch(self.b.id_to_piece(i)) if self.b.is_byte(i) else None
                b[i] = bytes([int(byte[1], 16)]) if byte else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.transducer = Transducer(a, b)
        self.a_bytes, self.a_sizes = pa.array(a, pa.large_binary()), np.fromiter(map(len, a), np.int64, len(a))
        # Items: A's tokens, then B's, each followed by a comma or, last of its group's side, by the sign that ends the side.
        self.b_items = 2 * len(a)
        self.shown = pa.array([f"{i}{sign}" for n, end in ((len(a), "|"), (len(b), ";")) for i in range(n) for sign in (",", end)], pa.large_string())

    def _a_ids(self, texts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all texts, and how many each has. sizes: the texts' bytes.

        After a text that doesn't end in white space A starts anew at the next one's blank, so such texts are encoded in a row
        and told apart by their tokens' bytes; the others, and rows whose tokens don't end with the texts, one by one.
        """
        alone = np.fromiter((t[-1].isspace() for t in texts), bool, len(texts))
        order = np.argsort(alone, kind="stable")
        alone, sizes = alone[order], sizes[order]
        row = np.where(alone, -1 - np.arange(len(texts)), np.cumsum(sizes) // ROW_BYTES)
        cuts = np.append(np.flatnonzero(np.diff(row, prepend=len(texts) + row[:1])), len(texts)).tolist()
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, upto in zip(cuts, cuts[1:]):
            part = [texts[i] for i in order[at:upto].tolist()]
            own = np.array(self.a.encode("".join(part), add_special_tokens=False).ids, np.int64)
            own_sizes, ends = self.a_sizes[own], np.cumsum(sizes[at:upto])
            token_ends = np.cumsum(own_sizes)
            last = np.searchsorted(token_ends, ends)
            if len(part) == 1:
                own_lengths = np.array([len(own)])
            elif own_sizes.all() and token_ends[-1] == ends[-1] and np.array_equal(token_ends[last], ends):
                own_lengths = np.diff(last, prepend=-1)
            else:
                lists = [self.a.encode(t, add_special_tokens=False).ids for t in part]
                own, own_lengths = np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))
            ids.append(own)
            lengths.append(own_lengths)
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        if not alone.any():
            return ids, lengths
        back = np.argsort(order)
        return ids[_gather(_starts(lengths)[back], lengths[back])], lengths[back]

    def _b_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all texts, and how many each has. Lists of some texts at a time become numbers."""
        ids, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 4096):
            lists = self.b.encode([t[1:] for t in texts[at : at + 4096]], num_threads=1)
            lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), np.int64, int(lengths[-1].sum())))
        return np.concatenate(ids), np.concatenate(lengths)

    def aligned(self, texts: list[str]) -> Aligned:
        """texts begin with the blank that both sides start with."""
        n, raw = len(texts), [t.encode() for t in texts]
        raw_sizes = np.fromiter(map(len, raw), np.int64, n)
        a_ids, a_lengths = self._a_ids(texts, raw_sizes)
        b_ids, b_lengths = self._b_ids(texts)
        ids, ends = [a_ids, b_ids], [np.cumsum(a_lengths), np.cumsum(b_lengths)]
        good, group, of, pairs = self.transducer.groups(tuple(ids), tuple(ends))
        # The sides agree where good; A's bytes have to be the text's.
        spelled = self.a_bytes.take(pa.array(ids[0]))
        lengths = np.diff(np.concatenate([[0], ends[0]]))
        sizes = np.bincount(np.repeat(np.arange(n), lengths), pc.binary_length(spelled).to_numpy(), n).astype(np.int64)
        joined = b"".join(raw)
        own = spelled.buffers()[2]
        if not (np.array_equal(sizes, raw_sizes) and (own.to_pybytes() if own else b"")[: len(joined)] == joined):
            parts = pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends[0]]), spelled), pa.scalar(b"", pa.large_binary())).to_pylist()
            good &= np.fromiter((x == y for x, y in zip(parts, raw)), bool, n)
        return self._laid_out(n, good, ids, ends, group, pairs[good[of]])

    def _laid_out(self, n: int, good: np.ndarray, ids, ends, group, pairs: np.ndarray) -> Aligned:
        texts = [np.repeat(np.arange(n), np.diff(np.concatenate([[0], e]))) for e in ends]
        use = [good[t] for t in texts]
        counts = [np.bincount(t[u], minlength=n) for t, u in zip(texts, use)]
        groups = np.zeros(n, np.int64)
        np.maximum.at(groups, texts[0][use[0]], group[0][use[0]] + 1)
        first = _starts(groups)
        key = np.concatenate([2 * (first[t[u]] + g[u]) + side for side, (t, u, g) in enumerate(zip(texts, use, group))])
        item = np.concatenate([2 * ids[0][use[0]], self.b_items + 2 * ids[1][use[1]]])
        order = np.argsort(key, kind="stable")
        key, item = key[order], item[order]
        item += np.append(key[1:] != key[:-1], True)[: len(item)]
        return Aligned(good, (counts[0], counts[1], groups), item, pairs)

    def block(self, texts: pa.Array) -> dict[str, np.ndarray | list[str]]:
        """n_a, n_b, n_groups, groups_sha256 a text, and its pairs: text i has the rows ends[i - 1]:ends[i] of place and count; place is an index into pairs, whose counts in the block are total."""
        # Words between blanks are chunks, unless one is empty or ends in white space: such texts are cut by the pattern.
        words = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        names = [" " + w for w in coded.dictionary.to_pylist()]
        odd = np.array([n[-1].isspace() for n in names], bool)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.add.reduceat(odd[codes].astype(int), offsets[:-1]) > 0 if len(codes) else np.zeros(0, bool)
        number: dict[str, int] = {}
        parts = np.split(codes, offsets[1:-1]) if len(texts) else []
        for i in np.flatnonzero(cut).tolist():
            own = _CUT.split(" " + (texts[i].as_py() or ""))
            parts[i] = np.array([number.setdefault(c, len(names) + len(number)) for c in own], np.int64)
        names += number
        used, of = np.unique(np.concatenate([*parts, np.zeros(0, np.int64)]), return_inverse=True)
        chunks = self.aligned([names[u] for u in used.tolist()])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.repeat(np.arange(len(parts)), sizes)
        spoilt = np.bincount(text, ~chunks.good[of], len(parts)) > 0
        empty = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False) == 0
        # A text with a chunk whose bytes differ is encoded whole, which decides.
        whole = np.flatnonzero(spoilt & ~empty)
        again = self.aligned([" " + texts[i].as_py() for i in whole.tolist()])
        keep = ~(spoilt | empty)[text]
        of, text = of[keep], text[keep]
        at, rows = np.concatenate([text, whole]), np.concatenate([of, len(used) + np.arange(len(whole))])
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
        join = lambda f: np.concatenate([f(chunks), f(again)])
        n = len(parts)
        numbers = [np.bincount(at, join(lambda x, j=j: x.sizes[j])[rows], n).astype(np.int64) for j in range(3)]
        n_items, n_pairs, items = join(lambda x: x.n_items), join(lambda x: x.n_pairs), join(lambda x: x.items)
        pairs, places = np.unique(join(lambda x: x.pairs), return_inverse=True)
        starts, wide = (_starts(n_items), _starts(n_pairs)), max(len(pairs), 1)
        shas, per_text, place, count = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for first, upto in _pieces(numbers[0] + numbers[1]):
            own = rows[slice(*np.searchsorted(at, [first, upto]))]
            of_text = at[slice(*np.searchsorted(at, [first, upto]))] - first
            lists = pa.LargeListArray.from_arrays(_ends((numbers[0] + numbers[1])[first:upto]), self.shown.take(pa.array(items[_gather(starts[0][own], n_items[own])])))
            shown = pc.binary_join(lists, pa.scalar("", pa.large_string()))
            # Without the sign that ends the last group.
            shas += ["" if not n else hashlib.sha256(s.as_buffer().slice(0, len(s.as_buffer()) - 1)).hexdigest() for n, s in zip(numbers[2][first:upto].tolist(), shown)]
            # Links of a text; pairs by their places among the block's distinct ones.
            keys, times = np.unique(np.repeat(of_text, n_pairs[own]) * wide + places[_gather(starts[1][own], n_pairs[own])], return_counts=True)
            per_text.append(np.bincount(keys // wide, minlength=upto - first))
            place.append(keys % wide)
            count.append(times)
        place, count = np.concatenate(place), np.concatenate(count)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, count)
        return {"n_a": numbers[0], "n_b": numbers[1], "n_groups": numbers[2], "groups_sha256": shas, "place": place, "count": count, "ends": np.cumsum(np.concatenate(per_text)), "pairs": pairs, "total": total}


@lru_cache(maxsize=1)
def _aligner(spec: str, model: bytes) -> Aligner:
    return Aligner(spec, model)


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that: a worker that waits or goes on to sums would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        upto, held = at + 1, sizes[at]
        while upto < len(texts) and held + sizes[upto] <= BLOCK_BYTES:
            held += sizes[upto]
            upto += 1
        yield slice(at, upto)
        at = upto


def align(docs: DataFrame, spec: str, model: bytes, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of texts with their groups and pairs, written to folder: block, doc_id, n_a, n_b, n_groups, groups_sha256, ends, held (see packed()), pairs, total."""
    held = docs.sparkSession.sparkContext.broadcast((spec, model))  # two vocabularies

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for part in _slices(texts):
                b = _aligner(*held.value).block(texts[part])
                one = lambda a, t: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(t) if isinstance(a, pa.Array) else pa.array(a, t))
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number - 1], pa.int64()), one(batch.column("doc_id")[part], pa.int64()), *(one(b[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")), one(b["groups_sha256"], pa.string()), one(b["ends"], pa.int64()), pa.array([packed(b["place"], b["count"])], pa.binary()), *(one(b[c], pa.int64()) for c in ("pairs", "total"))],
                    names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "ends", "held", "pairs", "total"],
                )
                del b
                _give_back()

    fields = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, ends array<long>, held binary, pairs array<long>, total array<long>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInArrow(aligned, fields), folder)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, links, best: the corpus-wide links of each pair, and whether no pair of the same B id has more."""
    cells = blocks.select(F.explode(F.arrays_zip("pairs", "total")).alias("c")).select(F.col("c.pairs").alias("pair"), F.col("c.total").alias("n"))
    counts = cells.groupBy("pair").agg(F.sum("n").alias("links")).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    # At most a row for each pair of ids, so for each B id at most as many as A has ids.
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def table(pair_counts: DataFrame) -> DataFrame:
    """a, b, links, best: the alignment table of the two vocabularies."""
    return pair_counts.select(F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "links", "best")


def summed(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row a text."""
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    met = join_hot(asked, counts, "pair", ["block"])
    # A block's distinct pairs, in the order of its list.
    answers = met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "links", "best"))).alias("s")).select("block", F.col("s.links").alias("links"), F.col("s.best").alias("best"))
    whole = blocks.drop("pairs", "total").join(answers, "block", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligner.cache_clear()  # of a worker that encoded texts before
        _give_back()
        for batch in batches:
            for i in range(batch.num_rows):
                own = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: B023, E731
                array = lambda name: own(name).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                ends = np.concatenate([[0], array("ends")]).astype(np.int64)
                place, count = unpacked(batch.column("held")[i].as_buffer(), int(ends[-1]))
                sums = []
                for weight in (1, array("best").astype(np.int64)[place] if len(place) else 1, array("links")[place] if len(place) else 1):
                    sums.append(pa.array(np.diff(_ends(count * weight)[ends])))
                yield pa.RecordBatch.from_arrays([own("doc_id"), own("n_a"), own("n_b"), own("n_groups"), *sums, own("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return whole.mapInArrow(texts, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_tokens(docs: DataFrame, spec: str, model: bytes) -> DataFrame:
    """docs: doc_id, text. See summed()."""
    folder = work_dir(docs.sparkSession, "alignment")
    blocks = align(docs, spec, model, f"{folder}/blocks")
    return summed(blocks, written(pair_counts(blocks), f"{folder}/pairs"))
