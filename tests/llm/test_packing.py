import itertools
import random
import zlib

import numpy as np
import pytest

from tests.llm import tables
from tidepool.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path(P.TOKENIZER))


def expected(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


ODD = ["", " ", "don't STOP it's", "<|endoftext|> a", "x<|endoftext|>y", "<|startoftext|><|startoftext|>", "A<|STARTOFTEXT|> <|endoftext|", "é<|endoftext|>日本", "a <|startoftext|> b<|endoftext|>\x1c", "a\x1cb\x1f c", "x\x85y\xa0z w", "ΑΣ ΣΑΣ Σ", "İstanbul ıI", "é ÅÅ", "日本語 テスト🙂", "12 3.4½²", "ǅǄ ǆ", "à́ ᾳ", "_a_b__", "naïve cafés ÀÉ", "ﬁn ­ x", "##'s 's'S"]


def test_ids_equal_the_tokenizer_s(monkeypatch):
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(9, 0x300)] + list("'''sstlmre  \n日🙂ß") + ["́", " "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", " ", "é", "Wo", "'s", "1"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(500)]
    t = P.Tokens(PATH)
    for x, ids in zip(texts, expected(texts)):
        assert t.encode(x) == np.array(ids, dtype="<u4").tobytes(), ascii(x)
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "REMEMBERED", 5)
    long = "some words that are longer than a block  " * 20
    assert t.encode(long) == np.array(expected([long])[0], dtype="<u4").tobytes()


def check(counts, capacity):
    """Every piece placed once, no overlap, no gap."""
    p = P.Packing(counts, capacity)
    used, ranks = {}, {}
    for size, rank, n, first, offset in p.runs:
        for i in range(n):
            used.setdefault(first + i, []).append((offset, size))
            ranks.setdefault(size, []).append(rank + i)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    for x in used.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(used) == list(range(p.sequences))
    return p


def optimum(sizes, capacity):
    """Fewest sequences, by trying all."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + sizes[i] <= capacity:
                b = list(bins)
                b[b.index(k)] += sizes[i]
                go(i + 1, b)
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_random_instances():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 37, 100, 4096])
        counts = {s: rng.randint(1, 30) for s in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 40)))}
        p = check(counts, capacity)
        assert p.sequences >= -(-sum(s * n for s, n in counts.items()) // capacity)
    worse = 0
    for _ in range(60):
        sizes = sorted((rng.randint(2, 20) for _ in range(9)), reverse=True)
        counts = {s: sizes.count(s) for s in set(sizes)}
        worse += check(counts, 20).sequences - optimum(sizes, 20)
    assert 0 <= worse <= 3


def test_reduction_never_costs_a_sequence():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([12, 20, 30])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        p = P.Packing.__new__(P.Packing)
        p.capacity, p.left = capacity, {s: sizes.count(s) for s in set(sizes)}
        p.sizes, p.rank, p.sequences, p.fixed, p.runs = sorted(p.left), P.defaultdict(int), 0, 0, []
        p._reduce()
        rest = [s for s, n in p.left.items() for _ in range(n)]
        assert p.sequences + optimum(sorted(rest, reverse=True), capacity) == optimum(sizes, capacity), sizes


def test_reduction_fixes_what_dominates():
    assert P.Packing({4096: 5}).fixed == 5
    exact = P.Packing({3000: 4, 1096: 4})
    assert (exact.fixed, exact.sequences) == (4, 4)
    assert P.Packing({}).sequences == 0


def test_query_form(spark):
    texts = [*ODD, None, "word " * 9000, "word " * 4095, "word " * 4096, *[tables.sentences(random.Random(i), i * 7) for i in range(30)]]
    ids = list(range(len(texts)))
    rows = P.pack(tables.documents(spark, texts, ids), PATH).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for i, x in zip(ids, expected(texts)):
        x = [*x, 1]
        want = [(k, a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], dtype="<u4").tobytes())) for k, a in enumerate(range(0, len(x), 4096))]
        assert sorted(got[i]) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for _, own in itertools.groupby(places, key=lambda x: x[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 4096
    assert len(P.pack(tables.documents(spark, ["a", "a", None], [1, 1, None]), PATH).collect()) == 3
    assert P.pack(tables.empty(spark), PATH).count() == 0
