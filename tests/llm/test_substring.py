import hashlib
import random
import re

import pytest

from tests.llm import tables
from tidepool.llm import substring


def brute(rows, window):
    """doc_id, words, removed, digest of each row, straight from the definition."""
    seen, out = {}, {}
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            if k in seen:
                gone.update(range(p, p + window))
            seen[k] = 1
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id, text] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted((str(r[0]), *out[r[0], r[1] or ""]) for r in rows)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("window,start", [(20, 10), (8, 2), (6, 6), (20, 5), (16, 1)])
def test_equals_brute_force(spark, window, start):
    rng = random.Random(window)
    passage = tables.sentences(rng, 60)
    texts = [tables.sentences(rng, rng.randint(0, 90), 6 if i % 3 else 60) for i in range(30)]
    texts += [texts[3], texts[3] + " " + passage, passage, "the " * 200, passage.replace(" ", "\x0b", 9), None, "", " \t\n", passage + " end", "x" * 5000 + " " + passage]
    texts += [" ".join(["a", "b"]) + "   " + passage]
    ids = [rng.randrange(10**6) for _ in texts]
    rows = tables.rows(texts, ids) + [tables.rows([passage], [ids[5]])[0]] * 0
    frame = tables.documents(spark, texts, ids)
    assert got(substring.remove_repeats(frame, window, start)) == brute(rows, window)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rng = random.Random(2)
    p = tables.sentences(rng, 40)
    texts, ids = [p, p, p + " more", "one two", p], [5, 5, None, 5, 9]
    assert got(substring.remove_repeats(tables.documents(spark, texts, ids))) == brute(tables.rows(texts, ids), 20)
    assert substring.remove_repeats(tables.empty(spark)).count() == 0
    kept = substring.remove_repeats(tables.documents(spark, [p, p + " z"]), text_out=True).orderBy("doc_id").collect()
    assert [r.kept for r in kept] == [p, "z"]
    with pytest.raises(ValueError):
        substring.remove_repeats(tables.empty(spark), 20, 3)
