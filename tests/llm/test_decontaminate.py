import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm import tables
from tidepool.llm import decontaminate as D


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, n):
    windows = {}
    for item, text in items:
        w = fold(text)
        for i in range(len(w) - min(n, len(w)) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + min(n, len(w))]), set()).add("" if item is None else str(item))
    out = []
    for i, text in enumerate(texts):
        w, hit, found = fold(text), set(), set()
        for k in {len(x) for x in windows}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found |= windows[tuple(w[p : p + k])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def make(spark):
    rng = random.Random(4)
    items = [(i, tables.sentences(rng, rng.choice([0, 1, 3, 9, 10, 14]), 400)) for i in range(25)] + [(100, None), (101, "--- !!"), (3, "Ünïcode words, here AND there"), (None, tables.sentences(rng, 12, 400)), (None, "one more without an id")]
    texts = [tables.sentences(rng, rng.randint(0, 120), 400) for _ in range(20)]
    texts += [f"before {t} after" for _, t in items[:12] + items[-2:]] + [items[5][1], None, "", "ÜNÏCODE words here and there", "Ünïcode---WORDS\n(here) and.there", "pad " * 30000 + (items[8][1] or "")]
    return texts, items


def test_equals_brute_force_in_one_block_and_in_many(spark):
    texts, items = make(spark)
    docs = tables.documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(texts, items, 10)
    for most in (D.MAX_BYTES, 400):
        assert sorted(tuple(r) for r in D.contamination(docs, bench, max_bytes=most).collect()) == want
        kept = D.remove_contaminated(docs, bench, max_bytes=most)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[-1]]


def test_empty_tables_repeats_and_spans(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = tables.documents(spark, ["a b", None, "a b"], [1, None, 1])
    assert [r.contaminated for r in D.contamination(docs, bench).collect()] == [False] * 3
    some = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert D.contamination(tables.empty(spark), some).count() == 0
    texts = ["a B, c! d", "a b", None, "", "B-c", "é (b c) b c. 🙂"]
    cut = D.remove_spans(tables.documents(spark, texts).withColumn("hit", F.lit("x")), some)
    assert sorted((r.doc_id, r.text, r.n_chars, r.hit) for r in cut.collect()) == [(0, "a ! d", 5, "x"), (1, "a b", 3, "x"), (2, None, None, "x"), (3, "", 0, "x"), (4, "", 0, "x"), (5, "é (. 🙂", 6, "x")]
    assert D.remove_spans(tables.empty(spark), some).count() == 0 and sorted(r.text or "" for r in D.remove_spans(docs, bench).collect()) == ["", "a b", "a b"]


def test_spans_equal_brute_force_in_one_block_and_in_many(spark):
    texts, items = make(spark)
    docs, bench = tables.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    windows = {tuple(w[i : i + min(10, len(w))]) for _, t in items if (w := fold(t)) for i in range(len(w) - min(10, len(w)) + 1)}
    want = []
    for text in texts:
        w, hit = fold(text), set()
        for k in {len(x) for x in windows}:
            hit.update(q for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in windows for q in range(p, p + k))
        want.append([x for i, x in enumerate(w) if i not in hit])
    for most in (D.MAX_BYTES, 400):
        cut = D.remove_spans(docs, bench, max_bytes=most)
        assert cut.columns == docs.columns
        got = {r.doc_id: r for r in cut.collect()}
        assert [fold(got[i].text) for i in range(len(texts))] == want
        assert all(got[i].text == t for i, t in enumerate(texts) if len(fold(t)) == len(want[i]))


def test_a_block_is_as_large_as_it_says():
    import pickle

    rng = random.Random(5)
    items = [(i, tables.sentences(rng, rng.choice([4, 30, 300]), 400)) for i in range(3000)]

    class Rows:
        def toLocalIterator(self):
            return iter(items)

    blocks = list(D._blocks(Rows(), 1 << 20))
    assert len(blocks) > 4 and [x for b in blocks for x in b] == items
    for b in blocks:
        test = D.TestSet(b, 10)
        filters = sum(len(x[1]) for x in test.by_length.values())
        assert len(pickle.dumps(test)) < (1 << 20) + filters + 20_000
