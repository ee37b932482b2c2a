import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import tables
from tidepool.llm import language as L
from tidepool.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def read(spark, name):
    from pathlib import Path

    if not Path(DATA).is_dir():
        pytest.skip("the driver's tables aren't here")
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_quality_on_held_out_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = {r.doc_id: r for r in Q.score(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_quality_ignores_what_is_no_text(spark):
    """Held-out labels, languages and sources change nothing."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.score(moved, other).collect()}
    assert all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_quality_odd_rows(spark):
    good = ["Some words in a plain sentence. And one more of them."] * 6
    bad = ["$$$ &&& %%% ### $$$ !!! $$$ ###"] * 6
    docs = tables.documents(spark, [*good, *bad, None, "", "x " * 50000], [*range(12), 50, None, 51])
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)] + [(1, 1), (None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = Q.score(docs, labels).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id < 6) for r in got if r.doc_id is not None and r.doc_id < 12)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert {r.score for r in Q.score(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert Q.score(tables.empty(spark), labels).count() == 0


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) * [1, 2, 0.5]
    y = x @ np.array([[1, 0.3, 0], [0, 1, 0.2], [0, 0, 1]]) + [1, 0, 2]
    moments = {i: (len(d), d.mean(axis=0), d.T @ d / len(d)) for i, d in enumerate((x, y))}
    model = Q.Discriminant(moments, 0.1)
    pooled = np.sqrt((x.var(axis=0) + y.var(axis=0)) / 2)
    for label, d in enumerate((x, y)):
        s = np.cov(d.T, bias=True) / np.outer(pooled, pooled)
        s = 0.9 * s + 0.1 * np.trace(s) / 3 * np.eye(3)
        z = (x - d.mean(axis=0)) / pooled
        want = np.log(0.5) - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1]
        assert np.allclose(model.log_density(x, label), want)


def test_language_on_held_out_documents(spark):
    docs = read(spark, "documents")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_odd_rows(spark):
    texts = ["the words of this one here"] * 9 + ["das sind einige wörter von hier"] * 9 + [None, "", "12 !!", "DIE WÖRTER", "ж", "the " * 80000]
    langs = ["en"] * 9 + ["de"] * 9 + [None] * 6
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(zip(texts, langs))] + [(None, "the words", "en", "s", 0)], tables.DOCS).withColumns({c: F.lit(1) for c in tables.CLASHING})
    got = L.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (18, 19, 20)] == ["und"] * 3
    assert by[0].lang_pred == "en" and by[9].lang_pred == "de" and by[21].lang_pred == "de" and by[23].lang_pred == "en" and by[None].lang_pred == "en"
    assert by[22].lang_pred in ("en", "de") and by[22].score == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert L.identify(tables.empty(spark)).count() == 0


def test_filters_return_every_language_of_an_n_gram():
    from collections import Counter

    a, b = L.grams("gemeinsame worte hier"), L.grams("common words here")
    model = L.Filters({"x": (5, Counter(a.tolist())), "y": (4, Counter(b.tolist() + a[:3].tolist()))})
    assert all(m & 1 for m in model.masks(a).tolist()) and all(m & 2 for m in model.masks(b).tolist())
    assert all(m == 3 for m in model.masks(a[:3]).tolist())
    assert np.mean([m == 0 for m in model.masks(L.grams("zzzz qqqq xxxx jjjj")).tolist()]) > 0.9


def test_all_languages_are_learned(spark):
    import random

    rng = random.Random(4)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(130)}
    rows = [(x, " ".join(rng.sample(words[x], 8))) for x in words for _ in range(8 if x < "l070" else 4)]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (x, t) in enumerate(rows)], tables.DOCS)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    learned = {x for i, (x, _) in enumerate(rows) if not got[i].held_out}
    assert len(learned) > 128
    assert all(got[i].lang_pred == x for i, (x, _) in enumerate(rows) if x in learned)


def test_whole_texts_are_learned(spark):
    """What is only behind a long common header is known."""
    header = "permission is granted to copy this header " * 250
    rows = [("en", header + "the words of this one here " * 20)] * 9 + [("de", header + "das sind einige wörter von hier " * 20)] * 9 + [(None, "das sind einige wörter von hier"), (None, "the words of this one here")]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (x, t) in enumerate(rows)], tables.DOCS)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert [got[i].lang_pred for i in (18, 19)] == ["de", "en"] and min(got[18].score, got[19].score) > 0.7


def plain_statistics(text):
    """The statistics of one text, from their definitions."""
    import math
    import re

    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return [0.0] * 12
    few = Q.FEW
    marks, upper, shouts, bars, digits, stops, lines = (sum(data.count(bytes([c])) for c in kind) for kind in (b"#$%&*~^<>{}\\@=", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?", b"|", b"0123456789", b".,;:", b"\n"))
    k, size = len(words) + few, len(data) + 6 * few
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    distinct = (len(set(words)) + few) / k
    root = math.sqrt
    return [math.log1p(k), root(marks / size), root(upper / size), root(shouts / size), root(bars / size), root(digits / size), root(same), math.asin(root(distinct)) + 0.08 * math.log1p(k), math.log1p(size / k), root(stops / k), root(lines / k), math.log1p((marks + shouts + bars) / k)]


def test_quality_scores_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    good = [tables.sentences(rng, rng.randint(5, 120), 400).capitalize() + ".\nMore of it, 12." for _ in range(40)]
    bad = [" ".join(rng.choice(["$$$", "BUY", "now!!", "|", "x=y", "x=y", "99"]) for _ in range(rng.randint(4, 80))) for _ in range(40)]
    texts = good + bad + [None, "", "a a a a"]
    labels = [(i, int(i < 40)) for i in range(80)]
    x = np.array([plain_statistics(t) for t in texts])
    assert np.allclose(Q.vectors(texts), x)
    learn = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    classes = [x[[i for i in learn if (i < 40) == bool(c)]] for c in (0, 1)]
    pooled = np.sqrt(np.maximum(sum(len(c) * c.var(axis=0) for c in classes) / len(learn), 1e-8))
    density = []
    for c in classes:
        s = np.cov(c.T, bias=True) / np.outer(pooled, pooled)
        s = (1 - Q.SHRINKAGE) * s + Q.SHRINKAGE * max(np.trace(s) / 12, 1e-3) * np.eye(12)
        z = (x - c.mean(axis=0)) / pooled
        density.append(np.log(len(c) / len(learn)) - 0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    got = {r.doc_id: r.score for r in Q.score(tables.documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6


def plain_grams(text):
    """The n-grams of letters within words and over one of their edges."""
    import re

    said = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    return [said[i : i + 4] for i in range(len(said) - 3) if " " not in said[i + 1 : i + 3]]


def test_languages_equal_brute_force(spark):
    """Exact sets in the place of filters give the same languages, and nearly the same scores."""
    import random

    rng = random.Random(5)
    letters = {"x": "abcdefghij", "y": "fghijklmno", "z": "klmnopqrst"}
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(150)] for x, a in letters.items()}
    texts = [(x, " ".join(rng.choices(words[x], k=rng.randint(20, 60)))) for _ in range(40) for x in words]
    texts += [(None, " ".join(rng.choices(words["x"], k=30) + rng.choices(words["y"], k=20))), (None, "Abc, ABC! 12")]
    docs = spark.createDataFrame([(i, t, x, "s", 0) for i, (x, t) in enumerate(texts)], tables.DOCS)
    learned = {x: {g for i, (y, t) in enumerate(texts) if y == x and zlib.crc32(str(i).encode()) % 3 != 1 for g in plain_grams(t)} for x in words}
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    for i, (_, text) in enumerate(texts[:-1]):
        hits = sorted(((sum(g in own for g in plain_grams(text)), x) for x, own in learned.items()), reverse=True)
        assert got[i].lang_pred == hits[0][1]
        assert abs(got[i].score - hits[0][0] / (hits[0][0] + hits[1][0])) < 0.02
