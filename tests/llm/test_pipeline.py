import corpus_pipeline as C
from tests.llm import tables, test_near
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_secrets import base
from tidepool.llm import quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    import random

    rng = random.Random(12)
    item = tables.sentences(rng, 15, 400)
    texts = [f"{tables.sentences(rng, rng.randint(30, 90), 400).capitalize()}. And so on." for _ in range(40)]
    texts += [texts[1], texts[2] + " indeed", f"Words first. {item} Words after it.", texts[3] + " token = abcdef012345", None, ""]
    bad = ["$$$ &&& %%% ### " * rng.randint(3, 9) + "x" for _ in range(12)]
    texts += bad
    docs = tables.documents(spark, texts, clashing=False)
    labels = [(i, 0 if t in bad else 1, 0) for i, t in enumerate(texts)]
    write(spark, str(tmp_path), docs, labels, [(1, item), (2, None)])
    d, now = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for n, (_, stage) in enumerate(C.STAGES):
        now = stage(spark, now, d)
        now.write.parquet(f"{tmp_path}/out{n}")
        now = spark.read.parquet(f"{tmp_path}/out{n}")
        assert n == 4 or now.columns == COLUMNS
        kept.append({r.doc_id: r.text for r in now.collect()} if n < 4 else now.collect())
    all_texts = dict(enumerate(texts))
    scores = {r.doc_id: r.predicted for r in quality.score(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert set(kept[0]) == {i for i, p in scores.items() if p} and not any(all_texts[i] in bad for i in kept[0])
    classes = test_near.brute([(i, t) for i, t in kept[0].items()])
    assert set(kept[1]) == set(classes.values())
    ids = sorted(kept[1])
    dirty = {ids[r[0]] for r in leaks([kept[1][i] for i in ids], [(1, item), (2, None)], 10) if r[-1]}
    assert dirty and set(kept[2]) == set(kept[1]) - dirty
    assert set(kept[3]) == set(kept[2])
    for i, t in kept[3].items():
        assert not base(t or "") and (t == kept[2][i] or base(kept[2][i]))
    assert {r.doc_id for r in kept[4]} == set(kept[3])
    assert len(C.run(spark, d).collect()) == len(kept[4])


def test_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), tables.empty(spark), [], [])
    assert C.run(spark, str(tmp_path)).count() == 0
