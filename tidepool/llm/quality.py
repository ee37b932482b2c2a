"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics; each class of the labels
gets a mean and a covariance, shrunk towards a multiple of the identity.  A
score is the logistic of the difference of the two Mahalanobis log densities,
with the covariances' Cholesky factors worked out once.

Statistics and class moments cover all labelled rows: the moments are sums that
Spark adds up, so the driver sees one row for each class.  Texts are read once;
their vectors (a hundred bytes each) are kept in the shared checkpoint folder,
and labels join the vectors, not the texts.

Defined results: a null text is the empty text; a null doc_id is never a
training row; null labels are ignored; repeated label rows each count; with
one class of labels every score is that class's; without labels every score is
0.5; further columns of either table are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import pick, settle

#: The weight of the identity in a class covariance.
SHRINKAGE = 0.05
#: A document is kept from this score on.
THRESHOLD = 0.7

#: Words that every text is taken to have besides its own, so that rates of very short texts say little.
FEW = 15

FEATURES = ("words", "marks", "upper", "shouts", "bars", "digits", "stutter", "variety", "word length", "stops", "lines", "odd ends")

_CLASS = np.zeros(256, dtype=np.uint8)
for _c, _bytes in ((1, b"#$%&*~^<>{}\\@="), (2, bytes(range(65, 91))), (3, b"!?"), (4, b"|"), (5, b"0123456789"), (6, b".,;:"), (7, b"\n")):
    _CLASS[list(_bytes)] = _c


def vectors(texts: list[str | None]) -> np.ndarray:
    """The transformed statistics of whole texts, a row for each."""
    data = [(t or "").encode(errors="replace") for t in texts]
    out = np.zeros((len(data), len(FEATURES)))
    for first, last, h, bounds in W.chunks(data):
        for i in range(first, last):
            own = h[bounds[i - first] : bounds[i - first + 1]]
            size, k = len(data[i]), len(own)
            if not k:
                continue
            c = np.zeros(8)
            for at in range(0, size, W.BLOCK):
                c += np.bincount(_CLASS[np.frombuffer(data[i], dtype=np.uint8, count=min(W.BLOCK, size - at), offset=at)], minlength=8)
            same = float(np.count_nonzero(own[1:] == own[:-1])) / (k + FEW)
            distinct = (len(np.unique(own)) + FEW) / (k + FEW)
            size, k = size + 6 * FEW, k + FEW
            out[i] = (
                np.log1p(k),
                np.sqrt(c[1] / size),
                np.sqrt(c[2] / size),
                np.sqrt(c[3] / size),
                np.sqrt(c[4] / size),
                np.sqrt(c[5] / size),
                np.sqrt(same),
                np.arcsin(np.sqrt(distinct)) + 0.08 * np.log1p(k),
                np.log1p(size / k),
                np.sqrt(c[6] / k),
                np.sqrt(c[7] / k),
                np.log1p((c[1] + c[3] + c[4]) / k),
            )
    return out


class Discriminant:
    """Two Gaussian classes; log odds of class 1 for rows of statistics."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE):
        """moments: for each class the number of rows, their mean, and the mean of their outer products."""
        self.classes = {}
        total = sum(m[0] for m in moments.values())
        if not total:
            return
        d = len(next(iter(moments.values()))[1])
        pooled = sum(m[0] * (np.diag(m[2]) - m[1] ** 2) for m in moments.values()) / total
        self.scale = np.sqrt(np.maximum(pooled, 1e-8))
        for label, (n, mean, second) in moments.items():
            s = (second - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            s = (1 - shrinkage) * s + shrinkage * max(np.trace(s) / d, 1e-3) * np.eye(d)
            chol = np.linalg.cholesky(s)
            self.classes[label] = (np.log(n / total), mean, np.linalg.inv(chol).T, 2 * np.log(np.diag(chol)).sum())

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        prior, mean, whiten, log_det = self.classes[label]
        return prior - 0.5 * ((((x - mean) / self.scale) @ whiten) ** 2).sum(axis=1) - 0.5 * log_det

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), 0.5)
        if len(self.classes) == 1:
            return np.full(len(x), float(next(iter(self.classes))))
        return 1 / (1 + np.exp(np.clip(self.log_density(x, 0) - self.log_density(x, 1), -500, 500)))


def held_out(doc_id, mod: int, remainder: int):
    """Whether a document is kept from training: crc32 of its number as text."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == remainder, F.lit(False))


def describe(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, read once."""

    def run(batches):
        for batch in W.slices(batches, 1):
            x = vectors(batch.column(1).to_pylist())
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])

    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, x array<double>")


def fit(described: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Learns from every labelled row whose document isn't held out."""
    marks = pick(labels, "doc_id", "quality").select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(F.col("quality").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"), 4, 2))
    rows = described.join(marks, F.col("doc_id") == F.col("label_id"))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)] + [F.avg(F.col("x")[i] * F.col("x")[j]).alias(f"s{i}_{j}") for i, j in pairs]
    moments = {}
    for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"s{i}_{j}"]
        moments[r["quality"]] = (r["n"], np.array([r[f"m{i}"] for i in range(d)]), second)
    return Discriminant(moments, shrinkage)


def score(documents: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    described = settle(describe(documents))
    model = documents.sparkSession.sparkContext.broadcast(fit(described, labels, shrinkage))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.value.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = described.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier doesn't reject; scored where they are read, with no shuffle of texts."""
    model = documents.sparkSession.sparkContext.broadcast(fit(settle(describe(documents)), labels, shrinkage))
    at = documents.columns.index("text")

    def run(batches):
        for batch in W.slices(batches, at):
            keep = model.value.scores(vectors(batch.column(at).to_pylist())) >= threshold
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(run, documents.schema)
