"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Both sides are folded the same way: A-Z to lower case, every other ASCII
character but letters and digits is a gap between words.  Each benchmark item
gives its windows of ``n`` consecutive words (an item of fewer words is one
window); their hashes are broadcast, every training window is looked up in
them, and each hit is verified by comparing words.  There is no shuffle: the
documents are read once and each task needs only its own rows.

The hash set is broadcast only up to ``MAX_BYTES``.  A larger benchmark is cut
into blocks within that bound and the documents are read once for each block;
hits are then joined by document.

Defined results: a null or wordless text has no words, no hits and is clean;
a null or wordless item has no windows; items without an id are one item, whose
id is the empty string; repeated rows each get their own
result; an empty benchmark leaves every document clean; further columns of
either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .cluster import free_name, pick

#: Bytes of one broadcast block: its items' texts and what it holds for each of their words; its bit filters have up to 16 MB more for each length of windows.
MAX_BYTES = 32 << 20
#: Bytes for each word: a hash, a place, a size, an owner; and for each item.
FOR_WORD, FOR_ITEM = 20, 64

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class TestSet:
    """The windows of some benchmark items, by length, in arrays: sorted hashes, a bit filter before them, where each window's words lie in one pool of bytes, and whose they are."""

    __test__ = False

    def __init__(self, items: list[tuple], n: int):
        self.names, pool, at = [], [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for item_id, text in items:
            tokens = (text or "").encode(errors="replace").translate(W.FOLD).split()
            if not tokens:
                continue
            k = min(n, len(tokens))
            said = b" ".join(tokens)
            hashes, starts, ends = W.hash_words(said)
            last = len(tokens) - k + 1
            found.setdefault(k, []).append((W.windows(hashes, k), starts[:last] + at, (ends[k - 1 :] - starts[:last]).astype(np.int32), np.full(last, len(self.names), dtype=np.int32)))
            self.names.append("" if item_id is None else str(item_id))
            pool.append(said)
            at += len(said)
        self.pool = b"".join(pool)
        self.by_length = {}
        for k, parts in sorted(found.items()):
            keys, starts, sizes, owners = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = 16
            while bits < 24 and (1 << bits) < 64 * len(keys):
                bits += 1
            may = np.zeros(1 << bits, dtype=bool)
            may[keys >> np.uint64(64 - bits)] = True
            self.by_length[k] = (keys, may, np.uint64(64 - bits), starts[order].astype(np.int32), sizes[order], owners[order])

    def occurring(self, k: int, h: int, said: bytes) -> Iterator[str]:
        """The items with this window of k words, whose hash is h."""
        keys, _, _, starts, sizes, owners = self.by_length[k]
        for i in range(int(np.searchsorted(keys, h)), int(np.searchsorted(keys, h, side="right"))):
            if self.pool[starts[i] : starts[i] + sizes[i]] == said:
                yield self.names[owners[i]]


def _hits(folded: bytes, h: np.ndarray, test: TestSet, near: dict[int, np.ndarray]) -> tuple[np.ndarray, set[str]]:
    """Which words are hit, and the items whose windows occur, of one document; near: the places to verify, by window length."""
    hit, items, tokens = np.zeros(len(h), dtype=bool), set(), None
    for k, places in near.items():
        if not len(places):
            continue
        tokens = folded.split() if tokens is None else tokens
        hashes = W.windows(h, k)
        for p in places.tolist():
            said = b" ".join(tokens[p : p + k])
            for item in test.occurring(k, hashes[p], said):
                hit[p : p + k] = True
                items.add(item)
    return hit, items


def scan(texts: list[str | None], test: TestSet) -> Iterator[tuple[int, int, np.ndarray, set[str]]]:
    """(row, words, hit mask, items) of each text, whole."""
    folded = [(t or "").encode(errors="replace").translate(W.FOLD) for t in texts]
    for first, last, h, bounds in W.chunks(folded):
        near: dict[int, np.ndarray] = {}
        for k, (keys, may, shift, *_) in test.by_length.items():
            g = W.windows(h, k)
            p = np.flatnonzero(may[g >> shift])
            p = p[keys[np.minimum(np.searchsorted(keys, g[p]), len(keys) - 1)] == g[p]]
            d = np.searchsorted(bounds, p, side="right") - 1
            near[k] = p[p + k <= bounds[d + 1]]
        busy = np.unique(np.concatenate([np.searchsorted(bounds, p, side="right") - 1 for p in near.values()] or [np.empty(0, dtype=np.int64)])).tolist()
        busy = set(busy)
        for i in range(first, last):
            a, b = int(bounds[i - first]), int(bounds[i - first + 1])
            if i - first in busy:
                yield i, b - a, *_hits(folded[i], h[a:b], test, {k: p[(p >= a) & (p < b)] - a for k, p in near.items()})
            else:
                yield i, b - a, np.zeros(0, dtype=bool), set()


def _blocks(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded bytes; never more than one block is on the driver."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        said = (row[1] or "").encode(errors="replace").translate(W.FOLD)
        n = len(said) + FOR_WORD * len(said.split()) + FOR_ITEM
        if block and size + n > max_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def _ids_digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row for each document: how many words it has, how many are hit, and by which items."""
    spark, sides = documents.sparkSession, []
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = list(_two(_blocks(pick(benchmark, "item_id", "text"), max_bytes)))
    if len(blocks) == 1:
        test = spark.sparkContext.broadcast(TestSet(blocks[0], n))

        def run(batches):
            for batch in W.slices(batches, 1):
                rows = [(k, int(hit.sum()), len(items), _ids_digest(items)) for _, k, hit, items in scan(batch.column(1).to_pylist(), test.value)]
                k, hit, items, digest = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return docs.mapInArrow(run, SCHEMA)
    # Beyond one block: the hits of each block, put together by document.
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    for block in _blocks(pick(benchmark, "item_id", "text"), max_bytes):
        test = spark.sparkContext.broadcast(TestSet(block, n))

        def part(batches, test=test):
            for batch in W.slices(batches, 1):
                out = []
                for i, k, hit, items in scan(batch.column(1).to_pylist(), test.value):
                    if items:
                        out.append((i, np.flatnonzero(hit).tolist(), sorted(items)))
                at = pa.array([x[0] for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.string()))], ["doc_id", "text_key", "places", "items"])

        sides.append(keyed.mapInArrow(part, "doc_id long, text_key string, places array<long>, items array<string>").dropDuplicates(["doc_id", "text_key"]))
    found = sides[0]
    for s in sides[1:]:
        found = found.unionByName(s)
    found = found.groupBy("doc_id", "text_key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def count(batches):
        for batch in W.slices(batches, 1):
            k = [len((t or "").encode(errors="replace").translate(W.FOLD).split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(k, pa.int64())], ["doc_id", "text_key", "n_words"])

    d = keyed.mapInArrow(count, "doc_id long, text_key string, n_words long").alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_key") == F.col("f.text_key"))
    items = F.coalesce("f.items", F.array().cast("array<string>"))
    hits = F.coalesce("f.hits", F.lit(0).cast("long"))
    return d.join(found.alias("f"), on, "left").select("d.doc_id", "d.n_words", hits.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


def _two(blocks: Iterator) -> Iterator:
    """At most the first two: enough to know if there is more than one."""
    for _, b in zip(range(2), blocks):
        yield b


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of a benchmark item occurs; texts go through one filter for each block."""
    clean, at = documents, documents.columns.index("text")
    for block in _blocks(pick(benchmark, "item_id", "text"), max_bytes):
        test = documents.sparkSession.sparkContext.broadcast(TestSet(block, n))

        def keep(batches, test=test):
            for batch in W.slices(batches, at):
                yield batch.filter(pa.array([not items for *_, items in scan(batch.column(at).to_pylist(), test.value)], pa.bool_()))

        clean = clean.mapInArrow(keep, clean.schema)
    return clean


def _without(text: str, places: list[int]) -> str:
    """The text less these words, counted in its folded form; runs of them go with what is between, everything else stays as it is."""
    data = text.encode(errors="replace")
    _, starts, ends = W.hash_words(data.translate(W.FOLD))  # folding keeps every byte's place
    out, at, p = [], 0, np.asarray(places, dtype=np.int64)
    breaks = np.flatnonzero(np.diff(p) > 1)
    for a, b in zip(p[np.concatenate(([0], breaks + 1))], p[np.concatenate((breaks, [len(p) - 1]))]):
        out.append(data[at : starts[a]])
        at = int(ends[b])
    return b"".join([*out, data[at:]]).decode()


def remove_spans(documents: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents, with all their columns, less the hit words of their texts; n_chars, if there, follows the text.

    Hits are judged on the input: the places of each block's hits travel with
    the rows, and words go only behind the last block.
    """
    at, name = documents.columns.index("text"), free_name(documents, "hit")
    marked = documents.withColumn(name, F.array().cast("array<int>"))
    for block in _blocks(pick(benchmark, "item_id", "text"), max_bytes):
        test = documents.sparkSession.sparkContext.broadcast(TestSet(block, n))

        def mark(batches, test=test):
            for batch in W.slices(batches, at):
                places = batch.columns[-1].to_pylist()
                for i, _, hit, items in scan(batch.column(at).to_pylist(), test.value):
                    if items:
                        places[i] = np.union1d(places[i], np.flatnonzero(hit)).astype(np.int32).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places, pa.list_(pa.int32()))], batch.schema.names)

        marked = marked.mapInArrow(mark, marked.schema)

    def cut(batches):
        for batch in W.slices(batches, at):
            columns, schema = batch.columns[:-1], pa.schema(list(batch.schema)[:-1])
            texts = [_without(t, p) if p else t for t, p in zip(columns[at].to_pylist(), batch.columns[-1].to_pylist())]
            if "n_chars" in schema.names:
                j = schema.names.index("n_chars")
                old = zip(columns[j].to_pylist(), batch.columns[-1].to_pylist(), texts)
                columns[j] = pa.array([len(t) if p else c for c, p, t in old], schema.field(j).type)
            columns[at] = pa.array(texts, schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return marked.mapInArrow(cut, documents.schema)
