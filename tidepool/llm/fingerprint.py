"""Document fingerprints: MinHash under universal hash permutations.

A text's shingles (five words in lower case) are hashed by ``PERMUTATIONS``
functions ``a * x + b`` modulo 2**64 at once in numpy, and each minimum leaves
one byte.  The share of equal bytes, corrected for bytes that agree by chance,
estimates the Jaccard similarity of the shingle sets.

``neighbours`` puts documents in order of their number by a range shuffle, so
each task sees most documents and their successors; the few at the edges of
tasks are joined by task number.  ``near_classes`` joins the bands of the full
signatures in Spark and verifies Jaccard similarities.

Defined results: a null text is empty; a text without words has one shingle of
its own, so equal texts have equal fingerprints and likeness 1; rows of equal
doc_id follow each other in the order of a hash of their texts; a null doc_id
comes first; a lone document is its own next one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from . import words as W
from .cluster import pick, settle
from .dart import band_hashes

PERMUTATIONS = 128
#: Bands of the near-duplicate join: 25 of 5 miss a pair of similarity 0.8 in 5 of 100,000 cases.
BANDS, ROWS = 25, 5

_A = W.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_B = W.mix(np.arange(1001, 1001 + PERMUTATIONS, dtype=np.uint64))

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a set of shingles."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        x = shingles[at : at + 512]
        np.minimum(low, (_A[:, None] * x[None, :] + _B[:, None]).min(axis=1), out=low)
    return low


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of bytes for each text."""
    data = [t.lower().encode(errors="replace") for t in texts]
    out = np.empty((len(data), PERMUTATIONS), dtype=np.uint8)
    for first, last, h, bounds in W.chunks(data):
        for i in range(first, last):
            own = W.shingles(h[bounds[i - first] : bounds[i - first + 1]])
            out[i] = (W.mix(minima(own if len(own) else near._wordless(data[i]))) & np.uint64(255)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated similarity of two fingerprints."""
    return float(min(1.0, max(0.0, (np.mean(a == b) - 1 / 256) / (1 - 1 / 256))))


def edit(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], prints: np.ndarray, next_texts: list[str], next_prints: np.ndarray) -> list[tuple]:
    edited = [edit(t, n) for t, n in zip(texts, next_texts)]
    other = fingerprints(edited)
    return [(d, len(t), hashlib.sha256(e.encode(errors="replace")).hexdigest(), p.tobytes().hex(), o.tobytes().hex(), likeness(p, o), likeness(p, n)) for d, t, e, p, o, n in zip(ids, texts, edited, prints, other, next_prints)]


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def neighbours(documents: DataFrame) -> DataFrame:
    """The fingerprints of every document and of its edited text, and their likeness."""
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        part = TaskContext.get().partitionId()
        held = None  # the last document so far: id, text, fingerprint

        def batch_of(rows: list[tuple], role: int, texts: list) -> pa.RecordBatch:
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(_KINDS)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([role] * len(rows), pa.int32()), *columns, pa.array(texts, pa.string())], ["part", "role", *_NAMES, "text"])

        for batch in W.slices(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = fingerprints(texts)
            if held is None:
                yield batch_of([(ids[0], *[None] * 6)], 1, [texts[0]])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate((held[2][None], prints))
            yield batch_of(_rows(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:]), 0, [None] * (len(ids) - 1))
            held = ids[-1], texts[-1], prints[-1]
        if held is not None:
            yield batch_of([(held[0], *[None] * 6)], 2, [held[1]])

    found = settle(ordered.mapInArrow(run, f"part int, role int, {RESULT}, text string"))
    parts = sorted(r["part"] for r in found.where("role = 1").select("part").collect())  # one number for each task
    after = documents.sparkSession.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    lasts = found.where("role = 2").select("part", "doc_id", "text").join(after, "part")
    firsts = found.where("role = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"))

    def edges(batches):
        for batch in W.slices(batches, 1):
            ids, texts, following = (batch.column(i).to_pylist() for i in range(3))
            rows = _rows(ids, texts, fingerprints(texts), following, fingerprints(following))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(_KINDS)], _NAMES)

    return found.where("role = 0").select(*_NAMES).unionByName(lasts.join(firsts, "next").select("doc_id", "text", "next_text").mapInArrow(edges, RESULT))


def signer(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    low = np.stack([minima(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])])
    return band_hashes(low[:, : BANDS * ROWS], BANDS)


def near_classes(documents: DataFrame, threshold: float = near.THRESHOLD) -> DataFrame:
    """doc_id and class_id of every document: bands of the permutations joined, Jaccard similarity verified."""
    return near.classes(documents, signer, threshold)
