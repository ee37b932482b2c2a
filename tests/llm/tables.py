"""Small tables with every odd row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that the operators use inside.
CLASHING = ["tag", "node", "bands", "lone", "first", "length", "bucket", "rank", "x", "key", "spans_", "text_", "n", "band", "root", "label_id", "quality", "part", "shard", "slot", "marked"]


def rows(texts, ids=None):
    return [(i if ids is None else ids[k], t, "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(enumerate(texts))]


def documents(spark, texts, ids=None, clashing=True):
    frame = spark.createDataFrame(rows(texts, ids), DOCS)
    if clashing:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit(7) for c in CLASHING})
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sentences(rng, n, vocabulary=60):
    return " ".join(rng.choice(WORDS[:vocabulary]) for _ in range(n))


_rng = random.Random(11)
WORDS = ["".join(_rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(_rng.randint(2, 9))) for _ in range(400)]
