import collections
import itertools
import random

import numpy as np

from tests.llm import tables
from tidepool.llm import cluster, dart, fingerprint, graphs, near


def brute(rows, threshold=0.8):
    sets = {r[0]: s for r, s in zip(rows, near.shingle_sets([(r[1] or "").encode() for r in rows]))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if near.jaccard(sets[a], sets[b]) >= threshold and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def copies(rng, text, n, words):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(words):
            w[rng.randrange(len(w))] = rng.choice(tables.WORDS)
        out.append(" ".join(w))
    return out


def texts(rng):
    base = [tables.sentences(rng, rng.randint(80, 200), 400) for _ in range(12)]
    out = list(base) + [base[0]] * 5 + [base[1].upper()]
    out += copies(rng, base[2], 40, 2) + copies(rng, base[3], 15, 5) + copies(rng, base[4], 25, 3)
    chain = base[5]
    for _ in range(6):  # each near the one before it, the ends far apart
        chain = copies(rng, chain, 1, 2)[0]
        out.append(chain)
    return out + [None, "", "...", "...", "!!!", "one", "One", "one two three", "z " * 20000, "z " * 20001]


def test_classes_equal_brute_force(spark):
    rng = random.Random(9)
    t = texts(rng)
    ids = rng.sample(range(10**6), len(t))
    docs = tables.documents(spark, t, ids)
    want = brute(tables.rows(t, ids))
    assert {r.doc_id: r.class_id for r in near.classes(docs, dart.signer).collect()} == want
    kept = near.keep_one(docs, dart.signer)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_permutation_bands_and_odd_rows(spark):
    rng = random.Random(10)
    t = texts(rng)[:60]
    docs = tables.documents(spark, t)
    assert {r.doc_id: r.class_id for r in fingerprint.near_classes(docs).collect()} == brute(tables.rows(t))
    odd = tables.documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None, "other words here"], [4, 4, None, 2, None])
    got = near.classes(odd, dart.signer).collect()
    assert len(got) == 5 and len({r.class_id for r in got if r.doc_id == 4}) == 1
    assert near.classes(tables.empty(spark), dart.signer).count() == 0 and near.keep_one(tables.empty(spark), dart.signer).count() == 0
    assert sum(r.doc_id == 4 for r in near.keep_one(odd, dart.signer).collect()) <= 1


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 80)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dart_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    k = 400
    for shared, own, weighted in [(50, 50, False), (400, 40, False), (5, 1, False), (60, 60, True), (2000, 300, True)]:
        keys = rng.integers(1, 2**63, shared + 2 * own, dtype=np.uint64)
        a, b = keys[: shared + own], np.concatenate((keys[:shared], keys[shared + own :]))
        weights = rng.exponential(3, shared + 2 * own) if weighted else np.ones(shared + 2 * own)
        wa, wb = weights[: shared + own], np.concatenate((weights[:shared], weights[shared + own :]))
        if weighted:
            wb = wb.copy()
            wb[: shared // 2] *= 0.5
        low = np.minimum(wa[:shared], wb[:shared]).sum()
        want = low / (wa.sum() + wb.sum() - low)
        sig = dart.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), np.concatenate((wa, wb)) if weighted else None, k)
        assert abs(np.mean(sig[0] == sig[1]) - want) < 0.1, (shared, own, weighted)
    one = dart.signatures(np.array([7, 7], dtype=np.uint64), np.array([0, 1, 2]))
    assert np.array_equal(one[0], one[1]) and (one != 0).all()


def test_fingerprints(spark):
    rng = random.Random(6)
    t = [tables.sentences(rng, rng.randint(0, 150), 400) for _ in range(25)] + [None, "", " ", "é", "🙂" * 7, "a b c", "a b c", "word " * 9000]
    ids = rng.sample(range(1000), len(t))
    rows = sorted(tables.rows(t, ids))
    out = {r.doc_id: r for r in fingerprint.neighbours(tables.documents(spark, t, ids)).collect()}
    import hashlib

    assert len(out) == len(t)
    for (i, text, *_), (_, following, *_) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (fingerprint.fingerprints([x])[0] for x in (text, edited, following))
        assert (out[i].fingerprint, out[i].edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert out[i].near_edited == fingerprint.likeness(a, b) and out[i].near_next == fingerprint.likeness(a, c)
    same = collections.defaultdict(set)
    for i, text, *_ in rows:
        same[text or ""].add(out[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert fingerprint.neighbours(tables.empty(spark)).count() == 0
    lone = fingerprint.neighbours(tables.documents(spark, ["a b c d e f g h"], [None])).first()
    assert lone.doc_id is None and lone.near_next == 1.0


def test_likeness_is_near_the_true_similarity():
    rng = random.Random(8)
    errors = []
    for _ in range(20):
        base = tables.sentences(rng, 200, 400)
        other = copies(rng, base, 1, rng.randint(0, 12))[0]
        a, b = near.shingle_sets([base.encode(), other.encode()])
        x, y = fingerprint.fingerprints([base, other])
        errors.append(abs(fingerprint.likeness(x, y) - near.jaccard(a, b)))
    assert sum(errors) / len(errors) < 0.06


def family(rng, sizes=(40, 300)):
    """Texts from a few templates, edited, cut and lengthened by every degree, many a little below or above 0.8 alike."""
    out = []
    for _ in range(4):
        base = tables.sentences(rng, rng.randint(*sizes), 400)
        for _ in range(35):
            w = copies(rng, base, 1, rng.randint(0, len(base.split()) // 20))[0].split()
            cut = rng.randint(0, len(w) // 8)
            out.append(" ".join(w[cut:] if rng.random() < 0.4 else w + rng.choices(tables.WORDS, k=cut) if rng.random() < 0.4 else w))
    return out


def test_candidates_lose_no_pair(spark):
    rng = random.Random(21)
    for threshold in (0.8, 0.6):
        t = family(rng) + ["one two", "one two", "a b c d e f"]
        sets = near.shingle_sets([x.encode() for x in t])
        nodes = spark.createDataFrame([(i, i // 3, len(s)) for i, s in enumerate(sets)], "node long, root long, n long")
        got = {(r.hub, r.node) for r in near._candidates(nodes, spark.createDataFrame(list(enumerate(t)), "node long, text string"), 5, threshold).collect()}
        want = {(a, b) for a, b in itertools.combinations(range(len(t)), 2) if a // 3 != b // 3 and near.jaccard(sets[a], sets[b]) >= threshold}
        assert want and want <= got
        assert all(a // 3 != b // 3 for a, b in got) and len(got) < 4 * len(want)


def test_families_around_the_threshold(spark):
    rng = random.Random(22)
    t = family(rng)
    assert {r.doc_id: r.class_id for r in near.classes(tables.documents(spark, t), dart.signer).collect()} == brute(tables.rows(t))


def test_small_tables_are_no_different_case(spark, monkeypatch):
    rng = random.Random(23)
    docs = tables.documents(spark, family(rng)[:70])
    one = sorted(near.classes(docs, dart.signer).collect())
    monkeypatch.setattr(cluster, "SMALL_ROWS", 0)
    assert sorted(near.classes(docs, dart.signer).collect()) == one


def test_recall_of_the_bands():
    """The share of pairs that share a band: what the bands alone lose."""
    rng = random.Random(24)
    for least, most, recall in ((0.8, 0.86, 1.0), (0.9, 1.0, 1.0), (0.68, 0.72, 0.9)):
        found = tried = 0
        while tried < 60:
            base = tables.sentences(rng, 150, 400)
            other = copies(rng, base, 1, rng.randint(1, 8))[0]
            sets = near.shingle_sets([base.encode(), other.encode()])
            if least <= near.jaccard(*sets) <= most:
                a, b = dart.signer(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
                found, tried = found + bool((a == b).any()), tried + 1
        assert found >= recall * tried, (least, found)
