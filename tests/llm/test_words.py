import random
import re

import numpy as np

from tidepool.llm import words as W


def test_hashes_tell_words_apart_and_don_t_depend_on_place():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\t\x0b\x0c\n\r.日") for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 100]
    known = {}
    for first, last, h, bounds in W.chunks(texts):
        for i in range(first, last):
            words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", texts[i])
            own = h[bounds[i - first] : bounds[i - first + 1]]
            assert len(own) == len(words)
            for word, x in zip(words, own.tolist()):
                assert known.setdefault(word, x) == x
    assert len(set(known.values())) == len(known)


def test_long_texts_are_cut_at_blanks(monkeypatch):
    text = b" ".join(b"w%d" % (i % 97) for i in range(3000)) + b" " + b"y" * 700
    want = W.hash_words(text)
    monkeypatch.setattr(W, "BLOCK", 128)
    got = W.hash_words(text)
    assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_windows():
    h = W.mix(np.array([1, 2, 3, 1, 2, 3, 4], dtype=np.uint64))
    for k in range(1, 9):
        w = W.windows(h, k)
        assert len(w) == max(0, 8 - k)
        for i in range(len(w)):
            for j in range(len(w)):
                assert (w[i] == w[j]) == (h[i : i + k].tolist() == h[j : j + k].tolist())
