import random
import re

import brute
import pyarrow as pa
import pytest

from timberline.llm.words import ALNUM_LOWER, PIECE, SPACED, SPACED_LOWER, slices, split_words, text_buffers, words_of

ALPHABET = "ab \t\nÄñ,.A\x0b9\x00"


@pytest.mark.parametrize("rule,pattern,lower", [(SPACED, r"[^\x20\x09-\x0D]+", False), (SPACED_LOWER, r"[^\x20\x09-\x0D]+", True),
                                                (ALNUM_LOWER, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)])
def test_words_and_windows(rule, pattern, lower):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 50, 3000]))) for _ in range(200)]
    texts += [None, "x" * (PIECE + 99), "y " * PIECE]
    want = [re.findall(pattern, brute.lower(t) if lower else t) if t else [] for t in texts]
    w = words_of(texts, rule)
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for t in want for x in t]
    got = [w.data[a:b].tobytes().decode() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    assert [brute.lower(g) if lower else g for g in got] == flat
    of_word, of_window = {}, {}
    windows, ok = w.windows(3)
    i = 0
    for t in want:
        for j, x in enumerate(t):
            assert of_word.setdefault(x, w.hash[i]) == w.hash[i]
            assert ok[i] == (j + 3 <= len(t))
            if ok[i]:
                assert of_window.setdefault(tuple(t[j : j + 3]), windows[i]) == windows[i]
            i += 1
    assert len(set(of_word.values())) == len(of_word) and len(set(of_window.values())) == len(of_window)


def test_slices_cover_all_texts_and_sliced_arrays():
    texts = pa.array(["skip", "a b", None, "", "c" * 50, "d e f"]).slice(1)
    data, bounds = text_buffers(texts)
    parts = [split_words(data, bounds[lo : hi + 1], SPACED).counts.tolist() for lo, hi in slices(bounds, 10)]
    assert sum(parts, []) == [2, 0, 0, 1, 3]
    assert words_of([], SPACED).counts.tolist() == []
