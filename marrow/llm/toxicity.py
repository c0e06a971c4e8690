"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts and one on windows of ordinary texts.
A window is one word in lower case, without punctuation; a longer run is cut into overlapping windows of
``WINDOW_BYTES`` bytes, so that every byte of a text lies in a window. A window is compressed as three copies in
a row, so that no frame falls back to stored bytes, and the trained dictionaries are used for their content
alone (their entropy tables would make lengths under two dictionaries incomparable). A window's margin is its
length under the ordinary dictionary less that under the toxic one. A text is described by its windows'
margins: the largest, and how many reach the calibrated threshold, absolutely and for the text's length. A
logistic curve over these, fitted on margins of labelled texts that the dictionaries did not see, makes a score
between 0 and 1.

Toxic texts consist of ordinary windows for the most part, and a dictionary holds what is frequent. So the
windows to train on are sampled by contrast: those of toxic texts that hold a run of characters which is several
times likelier in the sample's toxic texts train the toxic dictionary, as often as texts hold them; all others
train the ordinary one. Compression alone decides about texts: runs are not kept in the model.

Fitting uses a bounded sample: at most ``SAMPLE_ROWS`` labelled rows of each class, those with the
smallest hashed ids among texts of at most ``SAMPLE_TEXT_CHARS``. Everything else is one map over all
texts. Words repeat, so a worker keeps the margins of words it has seen; the cache is bounded and never
changes a score. The windows of a slice that aren't known are compressed together, in the order of their
letters: neighbours then meet the same places of a dictionary, which saves most of the time that each takes.

Defined cases: a null, empty or blank text has no windows, margins zero, and so the score of a text
without marks; repeated and null doc_ids are texts of their own; labels that are null are not used, and
an id with both labels counts as toxic; without labels of both classes every score is the share of
toxic labels, 0 if there are none; an empty table gives an empty result; other columns are carried
along.
"""

from __future__ import annotations

import pickle
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1_500
TOXIC_BYTES, ORDINARY_BYTES = 8_192, 110_000
SEGMENT, DMER = 96, 6
LEVEL = 19
WINDOW_BYTES = 16
#: A run of so many characters parts the classes if it is so many times likelier in toxic texts, at so large a
#: G statistic, and is in at least this share of them.
GRAM, RATIO, EVIDENCE, SUPPORT = 5, 4.0, 20.0, 0.01
#: Windows that a dictionary is trained on, drawn from all if there are more.
MOST_WINDOWS = 100_000
#: Hashes that tell near copies in the sample.
COPY_SEEDS = 4
FOLDS = 4
FEATURES = 4
THRESHOLDS = range(2, 8)
#: Longer labelled texts are left out of the sample, which bounds its bytes.
SAMPLE_TEXT_CHARS = 30_000
CACHE_WORDS = 250_000
#: Bytes of text whose windows are scored at a time.
SLICE_BYTES = 1_000_000
#: Runs, and windows, that are looked up at a time, of a slice or of a text longer than that.
RUNS_AT_ONCE = 100_000
_MARKS = regex.compile(r"[\p{P}\p{S}]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    weights: tuple[float, ...]
    prior: float


def windows_of(run: str) -> list[str]:
    """The windows of a run without blanks: its words in lower case, cut with overlaps where they are longer than a window."""
    run = run.lower().strip(string.punctuation)
    if run.isalnum() and len(run if run.isascii() else run.encode()) <= WINDOW_BYTES:  # a word without marks
        return [run]
    out = []
    for word in _MARKS.split(run):
        w = word.encode()
        if len(w) <= WINDOW_BYTES:
            out += [word] if w else []
        else:
            step = WINDOW_BYTES // 2
            out += [w[at : at + WINDOW_BYTES].decode(errors="ignore") for at in range(0, len(w) - step, step)]
    return out


def runs(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different runs without blanks, the position of each run of the texts among them, and where each text's runs begin and end."""
    found = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = found.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), found.offsets.to_numpy() - found.offsets[0].as_py()


def windows(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The different windows, and for each text its windows in their order, as positions among them."""
    names, at, ends = runs(texts)
    vocabulary: dict[str, int] = {}
    of = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in windows_of(run)], np.int64) for run in names]
    return list(vocabulary), [np.concatenate([np.zeros(0, np.int64), *[of[i] for i in part]]) for part in np.split(at, ends[1:-1])] if len(texts) else []


def _copies(word: str) -> bytes:
    w = word.encode()[:WINDOW_BYTES]
    return b" " + w + b" " + w + b" " + w + b" "


class Margins:
    """Margins of words under a pair of dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def coder(content: bytes) -> zstandard.ZstdCompressor:
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)

        self.toxic, self.ordinary = coder(toxic), coder(ordinary)
        self.cache: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        """The margins of windows."""
        asked: dict[str, int | None] = dict.fromkeys(words)
        for w in asked:
            asked[w] = m if (m := self.cache.get(w)) is not None else self.before.get(w)
        # Neighbours in this order meet the same places of a dictionary.
        new = sorted(w for w, m in asked.items() if m is None)
        if new:
            copies = [_copies(w) for w in new]
            toxic, ordinary = (map(len, coder.multi_compress_to_buffer(copies)) for coder in (self.toxic, self.ordinary))
            asked.update((w, b - a) for w, a, b in zip(new, toxic, ordinary))
        if len(self.cache) + len(asked) > CACHE_WORDS // 2:  # windows not asked for since the last change are forgotten
            self.before, self.cache = self.cache, {}
        self.cache.update(asked)
        return np.fromiter(map(asked.__getitem__, words), np.int64, len(words))

    def of_runs(self, names: list[str], thresholds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each run its largest margin above zero; for each threshold and run, how many of its margins reach that, and their sum."""
        largest, hits, total = np.zeros(len(names), np.int64), *(np.zeros((len(thresholds), len(names))) for _ in range(2))
        for at in range(0, len(names), RUNS_AT_ONCE):
            words, ends = [], []
            for run in names[at : at + RUNS_AT_ONCE]:
                words += windows_of(run)
                ends.append(len(words))
            margins = np.concatenate([np.zeros(0, np.int64), *[self.of(words[i : i + RUNS_AT_ONCE]) for i in range(0, len(words), RUNS_AT_ONCE)]])
            run_of = lambda those: at + np.searchsorted(ends, those, "right")  # noqa: B023, E731
            above = np.flatnonzero(margins > 0)
            np.maximum.at(largest, run_of(above), margins[above])
            for i, threshold in enumerate(thresholds):
                reached = np.flatnonzero(margins >= threshold)
                np.add.at(hits[i], run_of(reached), 1)
                np.add.at(total[i], run_of(reached), margins[reached])
        return largest, hits, total

    def features(self, texts: pa.Array, thresholds: list[int]) -> list[np.ndarray]:
        """A table for each threshold; a text's row: the largest margin above zero; logs of the count of margins that reach the threshold, of their share by length, and of their sum by length."""
        texts = texts.cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        out, at = [[np.zeros((0, FEATURES))] for _ in thresholds], 0
        while at < len(texts):
            upto, held = at, 0
            while upto < len(texts) and (upto == at or held + sizes[upto] <= SLICE_BYTES):
                held += sizes[upto]
                upto += 1
            names, of_text, ends = runs(texts.slice(at, upto - at))
            top, *reached = self.of_runs(names, thresholds)
            tops = np.append(top[of_text], 0)
            largest = np.where(np.diff(ends) > 0, np.maximum.reduceat(tops, ends[:-1]), 0)
            kilobytes = np.maximum(sizes[at:upto] / 1000, 0.2)
            for table, *of_run in zip(out, *reached):
                hits, total = (np.concatenate([[0], np.cumsum(x[of_text])]) for x in of_run)
                hits, total = hits[ends[1:]] - hits[ends[:-1]], total[ends[1:]] - total[ends[:-1]]
                table.append(np.stack([largest, np.log1p(hits), np.log1p(hits / kilobytes), np.log1p(total / kilobytes)], axis=1))
            at = upto
        return [np.concatenate(table) for table in out]


def unlike(codes: list[np.ndarray]) -> np.ndarray:
    """Which texts to use of a sample: not those that probably are near copies of an earlier one, whose words would count as often as they were copied.

    codes: each text's windows in their order, as numbers. Copies share the smallest hash of three windows in a row under one of a few seeds.
    """
    seen, keep = set(), np.ones(len(codes), bool)
    for i, c in enumerate(codes):
        c = c.astype(np.uint64)
        runs = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] if len(c) > 2 else c
        smallest = set()
        for seed in range(COPY_SEEDS if len(runs) else 0):
            h = (runs ^ np.uint64(0x165667B19E3779F9 * (seed + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            smallest.add((seed, int((h ^ (h >> np.uint64(29))).min())))
        keep[i] = seen.isdisjoint(smallest)
        seen |= smallest
    return keep


class Grams:
    """The runs of GRAM characters that windows hold, numbered once for all folds."""

    def __init__(self, vocabulary: list[str]):
        names: dict[str, int] = {}
        of = [[names.setdefault(r, len(names)) for r in {p[i : i + GRAM] for p in (f" {w} ",) for i in range(max(1, len(p) - GRAM + 1))}] for w in vocabulary]
        self.count, self.windows = len(names), len(vocabulary)
        self.starts = np.cumsum([0, *map(len, of)])
        self.flat = np.fromiter(chain.from_iterable(of), np.int32, self.starts[-1])

    def of(self, held: np.ndarray) -> np.ndarray:
        """The different runs of a text's windows."""
        return np.unique(np.concatenate([np.zeros(0, np.int32), *[self.flat[a:b] for a, b in zip(self.starts[held].tolist(), self.starts[held + 1].tolist())]]))

    def any(self, chosen: np.ndarray) -> np.ndarray:
        """Which windows hold a chosen run."""
        return np.logical_or.reduceat(chosen[self.flat], self.starts[:-1]) if self.windows else np.zeros(0, bool)


def contrast(grams: Grams, texts: list[np.ndarray], runs: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Which windows hold a run of characters that parts the classes. texts, runs: each one's different windows, and their different runs, by number."""
    texts_with = {True: np.zeros(grams.count), False: np.zeros(grams.count)}
    words_in = {True: np.zeros(grams.windows), False: np.zeros(grams.windows)}
    for held, own, y in zip(texts, runs, toxic.tolist()):
        texts_with[y][own] += 1
        words_in[y][held] += 1
    n, m = int(toxic.sum()), int((~toxic).sum())
    a, b = texts_with[True], texts_with[False]
    share = (a + b) / (n + m)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0.0)

    evidence = 2 * (part(a, n * share) + part(n - a, n * (1 - share)) + part(b, m * share) + part(m - b, m * (1 - share)))
    parts = (a >= max(4, SUPPORT * n)) & ((a + 0.5) / (n + 1) >= RATIO * (b + 0.5) / (m + 1)) & (evidence >= EVIDENCE)
    # A window that is itself about as frequent in ordinary texts isn't taken for a run that it happens to hold.
    own = words_in[True] * (m + 1) >= RATIO * words_in[False] * (n + 1)
    return own & (words_in[True] > 0) & grams.any(parts)


def _dictionaries(vocabulary: list[str], grams: Grams, texts: list[np.ndarray], runs: list[np.ndarray], toxic: np.ndarray) -> tuple[bytes, bytes]:
    counts = {y: np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for t, k in zip(texts, toxic) if k == y]]), minlength=len(vocabulary)) for y in (True, False)}
    chosen = contrast(grams, texts, runs, toxic)
    if not chosen.any():  # nothing parts the classes: each dictionary is that of its texts
        chosen = np.ones(len(vocabulary), bool)
        return _trained(vocabulary, counts[True], TOXIC_BYTES, 0), _trained(vocabulary, counts[False], ORDINARY_BYTES, 1)
    return _trained(vocabulary, counts[True] * chosen, TOXIC_BYTES, 0), _trained(vocabulary, counts[False] * ~chosen, ORDINARY_BYTES, 1)


def _trained(vocabulary: list[str], counts: np.ndarray, size: int, seed: int) -> bytes:
    """A dictionary trained on windows, each as often as the root of its count; the windows themselves if they are too few."""
    order = sorted(np.flatnonzero(counts), key=lambda i: (-counts[i], vocabulary[i]))
    drawn = np.repeat(order, np.maximum(1, np.round(np.sqrt(counts[order]))).astype(int)) if order else np.zeros(0, int)
    drawn = np.random.default_rng(seed).permutation(drawn)[:MOST_WINDOWS]
    try:
        return zstandard.train_dictionary(size, [_copies(vocabulary[i]) for i in drawn], k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(_copies(vocabulary[i]) for i in order)[-size:] or b" "


def _curve(weights: tuple[float, ...], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -35, 35)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Intercept and weights by Newton steps, lightly penalised so that separable data have an answer."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.array([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def fit_sample(texts: list[str], toxic: np.ndarray) -> Model:
    """The model from a bounded sample. Of texts that repeat, and of near copies, one is used.

    Dictionaries are trained on all folds but one, threshold and curve are calibrated on that one's margins, so
    that chance likenesses of these very dictionaries are allowed for. The best calibrated of the folds is the model.
    """
    prior = float(toxic.mean()) if len(toxic) else 0.0
    frame = pd.DataFrame({"text": texts, "y": toxic.astype(bool)}).drop_duplicates("text")
    y, plain = frame.y.to_numpy(), pa.array(frame.text.tolist(), pa.large_string())
    vocabulary, codes = windows(plain)
    used = unlike(codes)
    y, plain = y[used], plain.filter(pa.array(used))
    if min(y.sum(), (~y).sum()) < FOLDS:
        return Model(b"", b"", 0, (), prior)
    held = [np.unique(c) for c, k in zip(codes, used) if k]
    grams = Grams(vocabulary)
    own = [grams.of(h) for h in held]
    fold = np.zeros(len(y), int)
    for k in (True, False):
        fold[y == k] = np.arange((y == k).sum()) % FOLDS
    best = None
    for k in range(FOLDS):
        rest, other = np.flatnonzero(fold != k), fold == k
        pair = _dictionaries(vocabulary, grams, [held[i] for i in rest], [own[i] for i in rest], y[rest])
        for t, table in zip(THRESHOLDS, Margins(*pair).features(plain.filter(pa.array(other)), list(THRESHOLDS))):
            w = _logistic(table, y[other].astype(float))
            p = np.clip(_curve(w, table), 1e-12, 1 - 1e-12)
            loss = -np.mean(np.where(y[other], np.log(p), np.log(1 - p)))
            if best is None or loss < best[0] - 1e-9:
                best = (loss, Model(*pair, t, w, prior))
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """learnable: a condition on labels' id column; only such rows are looked at."""
    marked = labels.where(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = [F.xxhash64(F.col("_id"), F.lit(1)), "_id"]
    chosen = marked.where("_y = 1").orderBy(*order).limit(sample_rows).unionByName(marked.where("_y = 0").orderBy(*order).limit(sample_rows))
    # At most 2 x sample_rows rows, so the labels' side is broadcast.
    sample = docs.where(F.char_length(text_col) <= SAMPLE_TEXT_CHARS).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = sample.orderBy(F.xxhash64("_id", F.lit(2)), "_id", "_text").limit(2 * sample_rows).select("_y", "_text")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches, pa.schema([("_y", pa.int32()), ("_text", pa.string())]))
        model = fit_sample(held["_text"].to_pylist(), held["_y"].to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The bounded sample is fitted by one task, so neither its texts nor the training pass through the driver.
    found = rows.coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(found["model"]) if found else fit_sample([], np.zeros(0))


@lru_cache(maxsize=2)
def _margins(toxic: bytes, ordinary: bytes) -> Margins:
    return Margins(toxic, ordinary)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.prior)
    (x,) = _margins(model.toxic, model.ordinary).features(texts, [model.threshold])
    return _curve(model.weights, x)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(shared.value, texts), pa.float64())

    return docs.withColumn(name, scored(F.col(text_col)))
