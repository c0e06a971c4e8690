"""Unknown windows of a slice are compressed together and once, and runs are cut as the marks' pattern cuts them."""

import random

import numpy as np
import pyarrow as pa

from marrow.llm import toxicity

from .test_toxicity import MARKS, corpus


def plainly_cut(run):
    """The rule, without the shorter way for words without marks."""
    out, step = [], toxicity.WINDOW_BYTES // 2
    for word in toxicity._MARKS.split(run.lower()):
        w = word.encode()
        if len(w) <= toxicity.WINDOW_BYTES:
            out += [word] if w else []
        else:
            out += [w[at : at + toxicity.WINDOW_BYTES].decode(errors="ignore") for at in range(0, len(w) - step, step)]
    return out


def test_runs_are_cut_as_by_the_marks_pattern():
    rng = random.Random(8)
    signs = "abzAZ09éÉßİΣσ½²Ⅷ中́​.,-_'\"$+<=>^`|~«»—…€¿"
    found = ["".join(rng.choices(signs, k=rng.randint(0, 24))) for _ in range(4000)]
    found += ["ΑΣ", "ΑΣ.", ".ΑΣ.Β", "word,", "(Word)", "a" * 16, "a" * 17, "é" * 8, "é" * 9, "", "!", "...", "x.y"]
    assert [toxicity.windows_of(r) for r in found] == [plainly_cut(r) for r in found]


def test_no_letter_or_figure_is_a_mark():
    known = [c for c in map(chr, range(0x110000)) if c.isalnum()]
    assert not [c for c in known if toxicity._MARKS.search(c) or toxicity._MARKS.search(c.lower())]


class Counted:
    """A coder that notes what it is asked for."""

    def __init__(self, coder, log):
        self.coder, self.log = coder, log

    def multi_compress_to_buffer(self, items):
        self.log.append(list(items))
        return self.coder.multi_compress_to_buffer(items)


def counted(model):
    margins, log = toxicity.Margins(model.toxic, model.ordinary), []
    margins.toxic, margins.ordinary = Counted(margins.toxic, log), Counted(margins.ordinary, [])
    return margins, log


def test_unknown_windows_of_a_slice_are_compressed_together_in_order():
    model = toxicity.fit_sample(*corpus(300, 3))
    margins, log = counted(model)
    texts = pa.array([*corpus(40, 4)[0], None, "", "  ", "zu! Zu, (ZU)", " ".join(MARKS * 3)] * 2)
    first = margins.features(texts, [3])[0]
    assert len(log) == 1 and log[0] == sorted(set(log[0]))
    assert (margins.features(texts, [3])[0] == first).all() and len(log) == 1  # all are known now
    assert (first[:45] == first[45:]).all()


def test_texts_beyond_a_slice_and_forgotten_windows_keep_their_features(monkeypatch):
    model = toxicity.fit_sample(*corpus(300, 3))
    texts = pa.array([*corpus(30, 9)[0], "".join(corpus(20, 10)[0]), "q" * 5000, None, "."])
    whole = toxicity.Margins(model.toxic, model.ordinary).features(texts, [2, 3, 7])
    for name, value in (("RUNS_AT_ONCE", 7), ("CACHE_WORDS", 40), ("SLICE_BYTES", 2000)):
        monkeypatch.setattr(toxicity, name, value)
        margins = toxicity.Margins(model.toxic, model.ordinary)
        assert all((a == b).all() for a, b in zip(margins.features(texts, [2, 3, 7]), whole))
    assert len(margins.cache) + len(margins.before) <= toxicity.CACHE_WORDS


def test_runs_of_characters_are_numbered_once_for_all_folds(monkeypatch):
    made, one = [], toxicity.Grams
    monkeypatch.setattr(toxicity, "Grams", lambda vocabulary: made.append(1) or one(vocabulary))
    toxicity.fit_sample(*corpus(120, 5))
    assert len(made) == 1


def test_windows_with_a_run_that_parts_the_classes():
    vocabulary = ["grumbosh", "plain", "a", "grumbo", "kalo"]
    texts = [np.array(t) for t in [[0, 1], [0, 2], [3, 4], [0, 1, 4]] * 10 + [[1, 2], [2, 4], [1, 4], [1]] * 10]
    grams = toxicity.Grams(vocabulary)
    toxic = np.arange(80) < 40
    found = toxicity.contrast(grams, texts, [grams.of(t) for t in texts], toxic)
    assert found.tolist() == [True, False, False, True, False]
    assert len(toxicity.Grams([]).any(np.zeros(0, bool))) == 0 and len(grams.of(np.zeros(0, np.int64))) == 0
