"""Substring dedup by level-wise doubling.

A passage of ``window`` words can repeat only if each of its shorter windows
does, so windows of ``start`` words are counted first, and only where they
repeat is the window extended to twice that length, until it has ``window``
words; where no candidate survives, later levels send nothing.

At the first length it is enough to count the windows with the smallest hash
among those of a ``window``-word passage: equal passages have equal smallest
windows, so none is missed, and one window in eight is sent instead of all.

Nothing ever gathers the occurrences of one window.  At each level windows are
counted with partial sums before the shuffle, and what goes back to a document
are the windows that occur once (or, at the last level, first): each belongs to
one document, so the way back has no hot key, however common a passage is.  A
document's candidates are its windows less those.

Passages are told apart by 96 bits: a hash of their words' hashes, and half of one
made from other values for every byte.

Documents are put beside these lists by document, in a hash shuffle of texts;
texts that equal an earlier one take no part in the levels, since all their
windows start earlier.

Defined results: a null text has no words; documents of equal number are told
apart by their text and ordered by it, equal rows are one document and each row
gets its result; a null doc_id is ordered first; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import pick, release, settle

#: Words in a repeated passage, and the length at which counting starts.
WINDOW, START = 20, 5

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"

_SECOND = 0xA24BAED4963EE407


def _smallest(g: np.ndarray, ok: np.ndarray, start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``start`` words with hashes g: the smallest hash in each passage of ``window`` words (0 where ok says that it is no passage), and whether each window is some passage's smallest."""
    span = window - start + 1  # windows in a passage

    def slide(x: np.ndarray, size: int, f) -> np.ndarray:
        width = 1
        while width * 2 <= size:
            x = f(x[: len(x) - width], x[width:])
            width *= 2
        return f(x[: len(x) - (size - width)], x[size - width :]) if size > width else x

    low = np.where(ok, slide(g, span, np.minimum), np.uint64(0))
    padded = np.concatenate((np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)))
    return low, slide(padded, span, np.maximum) == g


def _passages(h: np.ndarray, bounds: np.ndarray, start: int, window: int):
    """g, low, chosen of one chunk of documents; nothing if no passage fits."""
    if len(h) < window:
        return None
    g = W.windows(h, start)
    low, chosen = _smallest(g, W.inside(bounds, window, len(h) - window + 1), start, window)
    return g, low, chosen


def _words(column: pa.Array) -> list[bytes]:
    return [(t or "").encode(errors="replace") for t in column.to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _place(bounds: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.searchsorted(bounds, p, side="right") - 1
    return d, p - bounds[d]


def _lone_starts(documents: DataFrame, start: int, window: int) -> DataFrame:
    """For each document the places of its counted ``start``-word windows that occur nowhere else."""

    def run(batches):
        for batch in W.slices(batches, 2):
            ids, tags, texts = batch.column(0), batch.column(1), _words(batch.column(2))
            for first, last, h, bounds in W.chunks(texts):
                if (found := _passages(h, bounds, start, window)) is None:
                    continue
                g, _, chosen = found
                p = np.flatnonzero(chosen)
                if not len(p):
                    continue
                keys, at, n = np.unique(g[p], return_index=True, return_counts=True)
                d, q = _place(bounds, p[at])
                rows = pa.array(d + first)
                yield pa.RecordBatch.from_arrays([_signed(keys), ids.take(rows), tags.take(rows), pa.array(q.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], ["g", "doc_id", "tag", "at", "n"])

    sent = documents.select("doc_id", "tag", "text").mapInArrow(run, "g long, doc_id long, tag int, at int, n int")
    lone = sent.groupBy("g").agg(F.sum("n").alias("n"), F.first("doc_id").alias("doc_id"), F.first("tag").alias("tag"), F.first("at").alias("at")).where("n = 1")
    return lone.groupBy("doc_id", "tag").agg(F.collect_list("at").alias("lone"))


def _candidates(g: np.ndarray, low: np.ndarray, chosen: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """Where the passages of one document start whose smallest window also occurs elsewhere."""
    p = np.flatnonzero(chosen)
    again = np.unique(g[np.setdiff1d(p, lone, assume_unique=True)])
    at = np.searchsorted(again, low)
    return np.flatnonzero((low != 0) & (at < len(again)) & (again[np.minimum(at, len(again) - 1)] == low)) if len(again) else np.empty(0, dtype=np.int64)


def _one(text: bytes, lone, start: int, window: int):
    """Word hashes and candidate passages of one document."""
    h = W.hash_words(text)[0]
    found = _passages(h, np.array([0, len(h)]), start, window)
    if found is None:
        return h, np.empty(0, dtype=np.int64)
    return h, _candidates(*found, np.asarray(lone if lone is not None else (), dtype=np.int64))


def _level(joined: DataFrame, start: int, window: int, length: int, firsts: bool) -> DataFrame:
    """Counts the candidates' windows of ``length`` words.

    firsts: for each document the places of the windows that start nowhere earlier; else of those that occur once.
    """

    def run(batches):
        for batch in W.slices(batches, 2):
            ids, tags, texts, lone = batch.column(0), batch.column(1), _words(batch.column(2)), batch.column(3).to_pylist()
            gone = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * len(texts)
            for i, text in enumerate(texts):
                h, p = _one(text, lone[i], start, window)
                if gone[i]:
                    p = np.setdiff1d(p, np.asarray(gone[i], dtype=np.int64), assume_unique=True)
                if not len(p):
                    continue
                one = W.windows(h, length)[p]
                # Before the last level a collision only keeps a candidate, so the first hash will do.
                two = W.windows(W.hash_words(text, W.OTHER)[0], length, _SECOND)[p] if firsts else np.zeros(len(p), np.uint64)
                one, at, n = np.unique(one, return_index=True, return_counts=True)  # at: the earliest place in this document
                many = np.minimum(n, 2).astype(np.int32)
                rows = pa.array(np.full(len(one), i))
                yield pa.RecordBatch.from_arrays([_signed(one), pa.array((two[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), ids.take(rows), tags.take(rows), pa.array(p[at].astype(np.int32)), pa.array(many)], ["g", "g2", "doc_id", "tag", "at", "n"])

    sent = joined.mapInArrow(run, "g long, g2 int, doc_id long, tag int, at int, n int")
    counted = sent.groupBy("g", "g2").agg(F.min(F.struct("doc_id", "tag", "at")).alias("x"), F.sum("n").alias("n"))
    if not firsts:
        counted = counted.where("n = 1")
    return counted.groupBy("x.doc_id", "x.tag").agg(F.collect_list("x.at").alias("first"))


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))


def remove_repeats(documents: DataFrame, window: int = WINDOW, start: int = START, text_out: bool = False) -> DataFrame:
    """What is left of each document without the words of passages that also start earlier.

    window is start, or start doubled some times.  text_out adds ``kept``, the remaining words joined by one space.
    """
    length = start
    while length < window:
        length *= 2
    if length != window:
        raise ValueError("window must be start times a power of two")
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", (F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))).cast("int").alias("tag"), "text")
    leaders = docs.select("doc_id", "tag", F.md5("text").alias("same")).groupBy("same").agg(F.min(F.struct("doc_id", "tag")).alias("x"))
    leaders = settle(leaders.select("x.doc_id", "x.tag"))
    lists = settle(_lone_starts(docs, start, window))
    release(spark)
    lists = leaders.alias("c").join(lists.alias("u"), _same("c", "u"), "left").select("c.doc_id", "c.tag", "u.lone", F.lit(True).alias("leads"))
    beside = docs.alias("d").join(lists.alias("l"), _same("d", "l"), "left")
    own = beside.where("l.leads").select("d.doc_id", "d.tag", "d.text", "l.lone")
    length, gone = start, None
    while length < window:
        length *= 2
        read = own if gone is None else own.alias("o").join(gone.alias("g"), _same("o", "g"), "left").select("o.*", "g.first")
        found = settle(_level(read, start, window, length, length == window))
        release(spark)
        if length == window:
            firsts = found
        else:
            both = found if gone is None else gone.unionByName(found)
            gone = both.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("first")).alias("first"))
    if window == start:
        firsts = settle(_level(own, start, window, window, True))
    whole = beside.join(firsts.alias("f"), _same("d", "f"), "left")
    columns = [F.col("d.doc_id"), F.col("d.text"), F.col("l.lone"), F.col("f.first"), F.col("l.leads")]
    if gone is not None:
        whole = whole.join(gone.alias("z"), _same("d", "z"), "left")
        columns.append(F.col("z.first").alias("dropped"))

    def run(batches):
        for batch in W.slices(batches, 1):
            ids, texts = batch.column(0), _words(batch.column(1))
            lone, first, leads = (batch.column(i).to_pylist() for i in (2, 3, 4))
            dropped = batch.column(5).to_pylist() if batch.num_columns > 5 else [None] * len(texts)
            out = []
            for i, text in enumerate(texts):
                tokens = text.split()
                n = len(tokens)
                if not leads[i]:  # all its passages start earlier, in the text it equals
                    keep = [] if n >= window else tokens
                else:
                    _, p = _one(text, lone[i], start, window)
                    for away in (first[i], dropped[i]):
                        if away:
                            p = np.setdiff1d(p, np.asarray(away, dtype=np.int64), assume_unique=True)
                    keep = tokens
                    if len(p):
                        change = np.zeros(n + 1, dtype=np.int32)
                        np.add.at(change, p, 1)
                        np.add.at(change, p + window, -1)
                        keep = [t for t, c in zip(tokens, np.cumsum(change[:-1]).tolist()) if not c]
                said = b" ".join(keep)
                out.append((n, n - len(keep), hashlib.sha256(said).hexdigest(), said.decode() if text_out else None))
            columns = [ids, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if text_out:
                columns.append(pa.array([x[3] for x in out], pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return whole.select(*columns).mapInArrow(run, SCHEMA + (", kept string" if text_out else ""))
