"""Every byte of a text lies in a window, and margins are those of direct compression."""

import numpy as np
import pyarrow as pa
import zstandard

from marrow.llm import toxicity
from tests.llm.test_toxicity import MARKS, corpus

SIZE = toxicity.WINDOW_BYTES


def words_of(texts):
    names, codes = toxicity.windows(pa.array(texts, pa.large_string()))
    return [[names[i] for i in c] for c in codes]


def test_long_runs_are_cut_into_overlapping_windows():
    run = "".join(chr(0x4E00 + i) for i in range(100))
    words = words_of(["Short, words-", run, "x" * 200 + " end", None, "a" * SIZE, " !! "])
    assert words[0] == ["short", "words"] and words[3] == [] and words[4] == ["a" * SIZE] and words[5] == []
    assert set("".join(words[1])) == set(run)
    assert all(any(run[i : i + 2] in w for w in words[1]) for i in range(99))
    assert words[2][-1] == "end" and {"x"} == set("".join(words[2][:-1])) and len(words[2][:-1]) == -(-200 // (SIZE // 2)) - 1
    assert all(len(w.encode()) <= SIZE for held in words for w in held)


def test_unicode_blanks_part_words():
    assert words_of(["one\u00a0two\u3000three"]) == [["one", "two", "three"]]


def test_features_against_direct_compression():
    model = toxicity.fit_sample(*corpus(300, 3))
    texts = [*corpus(20, 4)[0], "", "  ", "y" * 500, "Grumbosh! " * 30]

    def length(word, content):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(coder.compress(f" {word} {word} {word} ".encode()))

    found = toxicity.Margins(model.toxic, model.ordinary).features(pa.array(texts), [3])[0]
    for text, row in zip(texts, found):
        words = words_of([text])[0]
        margins = [length(w, model.ordinary) - length(w, model.toxic) for w in words]
        hits, size = [m for m in margins if m >= 3], max(len(text.encode()) / 1000, 0.2)
        assert np.allclose(row, [max([0, *margins]), np.log1p(len(hits)), np.log1p(len(hits) / size), np.log1p(sum(hits) / size)])


def test_marks_behind_long_runs_and_in_texts_without_blanks():
    model = toxicity.fit_sample(*corpus(600, 1))
    texts, y = corpus(200, 2)
    behind = pa.array(["".join(f"{'q' * 64}{w} " for w in t.split()[:20]) + " ".join(f"{'q' * 64}{m}" for m in MARKS * 12) for t in texts[:20]])
    assert (toxicity.scores(model, behind) > 0.5).mean() > 0.9
    joined = toxicity.scores(model, pa.array([t.replace(" ", "") for t in texts]))
    assert joined[y == 1].mean() > joined[y == 0].mean()
    assert (joined[y == 0] >= 0.5).mean() < 0.2


def test_near_copies_count_once():
    texts, _ = corpus(40, 6)
    copies = [t.replace("a", "a", 1) + " zu" for t in texts[:10]]
    _, codes = toxicity.windows(pa.array(texts + copies))
    assert toxicity.unlike(codes).tolist() == [True] * 40 + [False] * 10
