"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter over the n-grams of all languages: slot s holds
one bit for each language, in as many machine words as they need, that says that
some n-gram of language l hashed there.  One
lookup ANDs an n-gram's slots and so returns every language that may have it;
per-language popcounts over a text, corrected for each language's false
positives, decide.

It learns the n-grams of a bounded sample of labelled rows: for each language
the ``sample`` rows with the smallest hash of their number; learning and scoring
read whole texts.  The filter has a
fixed size for each 64 languages, and all languages are learned.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
ties go to the language with more training rows, then in alphabetical order;
a text with letters but no known n-gram gets that same first language with
score 0; without training rows all is ``und``; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .cluster import pick
from .quality import held_out

#: Training rows a language at most.
SAMPLE = 800
#: n-grams a language at most, most frequent first, and letters in an n-gram.
GRAMS, N = 12000, 4
#: Slots of the filter as a power of two, and lookups for each n-gram.
BITS, LOOKUPS = 18, 3
#: Parts in which the rows of a language are ranked.
PARTS = 256

_BLOCK = 1 << 18


def _letters() -> np.ndarray:
    """For code points of the basic plane: lower-case form of a letter, 0 for what isn't one; built from the Unicode rules Python has."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low[0]) if len(low) == 1 else c
    return table


_LETTER: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points, lower case; everything but letters is 0, and so are both ends."""
    if not _LETTER:
        _LETTER.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", errors="replace"), dtype=np.uint32)
    out = np.zeros(len(raw) + 2, dtype=np.uint64)
    basic = raw < 1 << 16
    out[1:-1] = np.where(basic, _LETTER[0][np.where(basic, raw, 0)], 0 if basic.all() else [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in raw.tolist()])
    return out


def grams(text: str, n: int = N) -> np.ndarray:
    """Hashes of the n-grams within words and over one edge of a word, in text order."""
    c = _codes(text)
    c = c[(c != 0) | np.concatenate(([True], c[:-1] != 0))]  # a run of other characters is one gap
    if len(c) < n:
        c = np.concatenate((c, np.zeros(n - len(c), dtype=np.uint64)))
    h, full = np.zeros(len(c) - n + 1, dtype=np.uint64), np.ones(len(c) - n + 1, dtype=bool)
    for i in range(n):
        part = c[i : len(c) - n + 1 + i]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1)
        if 0 < i < n - 1:
            full &= part != 0
    return W.mix(h[full])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Filters:
    """All languages' n-grams in one filter."""

    def __init__(self, counts: dict[str, tuple[int, Counter]], size: int = GRAMS):
        """counts: for each language its training rows and how often each n-gram occurs."""
        first = sorted(counts, key=lambda x: (-counts[x][0], x))
        self.languages = first
        self.slots = np.zeros((max(1, -(-len(first) // 64)), 1 << BITS), dtype=np.uint64)
        for bit, lang in enumerate(first):
            own = counts[lang][1]
            keys = np.array(sorted(own, key=lambda g: (-own[g], g))[:size], dtype=np.uint64)
            for at in self._places(keys):
                np.bitwise_or.at(self.slots[bit // 64], at, np.uint64(1 << bit % 64))
        self.false = np.array([float(np.mean(self.slots[b // 64] >> np.uint64(b % 64) & np.uint64(1))) ** LOOKUPS for b in range(len(first))])

    @staticmethod
    def _places(keys: np.ndarray) -> list[np.ndarray]:
        return [W.mix(keys + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS) for i in range(LOOKUPS)]

    def masks(self, keys: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram those of 64 languages that may have it, as bits."""
        out = None
        for at in self._places(keys):
            out = self.slots[word][at] if out is None else out & self.slots[word][at]
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        hits, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), _BLOCK):  # whole texts, a block at a time; n-1 characters are read again
            keys = grams(text[max(0, at - N + 1) : at + _BLOCK])
            n += len(keys)
            for word in range(len(self.slots)):
                masks = self.masks(keys, word)
                for b in range(64 * word, min(64 * word + 64, len(self.languages))):
                    hits[b] += np.count_nonzero(masks & np.uint64(1 << b % 64))
        true = np.maximum(0, (hits - self.false * n) / (1 - np.minimum(self.false, 0.99)))
        if true.sum() <= 0:
            return self.languages[0], 0.0
        best = int(np.argmax(true))
        rest = np.delete(true, best)
        return self.languages[best], float(true[best] / (true[best] + (rest.max() if len(rest) else 0)))


def fit(documents: DataFrame, sample: int = SAMPLE, size: int = GRAMS) -> Filters:
    """Learns from rows with a language that aren't held out."""
    docs = pick(documents, "doc_id", "text", "lang").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    # The numbers alone are ranked, first in parts of a language, so that none is ranked whole in one task; texts are fetched for the few chosen.
    chosen = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    for keys in (("lang", "part"), ("lang",)):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("in_lang"))
    rows = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("in_lang")), "left_semi")

    def count(batches):
        own: dict[str, Counter] = {}
        for batch in W.slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counter = own.setdefault(lang, Counter())
                for at in range(0, len(text or ""), _BLOCK):  # a block at a time, as in scoring
                    keys, n = np.unique(grams(text[max(0, at - N + 1) : at + _BLOCK]), return_counts=True)
                    counter.update(dict(zip(keys.tolist(), n.tolist())))
        out = [(lang, g - (1 << 63), n) for lang, c in own.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    counts: dict[str, tuple[int, Counter]] = {x: (n, Counter()) for x, n in totals.items()}
    for r in best.collect():  # at most size n-grams a language
        counts[r["lang"]][1][r["gram"] + (1 << 63)] = r["n"]
    return Filters(counts, size)


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, sample))

    def run(batches):
        for batch in W.slices(batches, 1):
            found = [model.value.decide(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
