"""Classes of near duplicates from signature bands, exact at the threshold.

Texts with equal shingle sets are one node, so exact copies, however many, meet
nowhere.  Nodes that share a band are candidates, but a band's nodes are never
paired off with each other:

1. Each is compared with the band's hub, the node that shares bands with most
   others.  A group of n copies of one text costs n comparisons, and links make
   components.
2. What is left are the nodes of bands whose other nodes lie in two components
   or more.  Two sets of sizes m and n that are similar enough have at least
   t / (1 + t) * (m + n) shingles in common, so in any one order of all shingles
   they have one among each set's first ones, up to so many behind it.  With the
   rarest first, few sets share such a shingle unless they are similar: a group
   of texts from one template that are all a little less alike than the
   threshold costs next to nothing.  Only pairs of different components that
   pass this test, with the places of the shingle and both sizes, are compared.
   It loses no pair, whatever the order.

A comparison fetches both texts and computes the Jaccard similarity of their
shingles.

Defined results: a null text is empty; texts without words are near only their
equals; rows of equal doc_id fall in one class; a row without doc_id is known
by a hash of its text, also in class ids; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graphs
from . import words as W
from .cluster import free_name, pick, release, settle

#: Words in a shingle, and the similarity from which texts are near duplicates.
SHINGLE, THRESHOLD = 5, 0.8
#: Sets whose sizes differ by less than this factor share a step of sizes.
STEP = 1.08

#: From the sets of many texts (elements one after the other, and bounds) to a row of band hashes for each.
Signer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The shingles of each text: its folded words, k at a time; for a text without words one element of its own."""
    out: list[np.ndarray] = []
    for first, last, h, bounds in W.chunks([t.translate(W.FOLD) for t in texts]):
        for i in range(first, last):
            own = W.shingles(h[bounds[i - first] : bounds[i - first + 1]], k)
            out.append(own if len(own) else _wordless(texts[i]))
    return out


def _wordless(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8).astype(np.uint64)
    return W.mix(np.array([len(data)], dtype=np.uint64) + (W.windows(W.mix(data + np.uint64(1)), len(data)) if len(data) else np.zeros(1, np.uint64)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sign(documents: DataFrame, signer: Signer, k: int) -> DataFrame:
    """doc_id, node, n, a, b (128 bits that tell shingle sets apart), bands."""

    def run(batches):
        for batch in W.slices(batches, 2):
            texts = [t.encode(errors="replace") for t in batch.column(2).to_pylist()]
            sets = shingle_sets(texts, k)
            bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            flat = np.concatenate(sets)
            bands = signer(flat, bounds)
            a = W.mix(np.add.reduceat(W.mix(flat), bounds[:-1]))
            b = W.mix(np.add.reduceat(W.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), bounds[:-1]))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), bands.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["doc_id", "node", "n", "a", "b", "bands"])

    return documents.mapInArrow(run, "doc_id long, node long, n long, a long, b long, bands array<long>")


def _compare(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those pairs (hub, node) whose texts are near duplicates."""
    own = pairs.join(texts.select("node", F.col("text").alias("own")), "node")
    full = own.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("other")), "hub")

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in W.slices(batches, 2):
            hubs, others = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            sets = shingle_sets([t.encode(errors="replace") for t in batch.column(2).to_pylist()], k)
            keep = []
            for hub, other, own in zip(hubs, others, sets):
                key = (hub, other)
                if key not in known:
                    known = {key: shingle_sets([other.encode(errors="replace")], k)[0]}  # rows come sorted by hub
                keep.append(jaccard(own, known[key]) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return full.select("hub", "node", "own", "other").mapInArrow(run, "a long, b long")


def _shingle_rows(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """node, shingle: every distinct shingle of the texts of some nodes."""

    def run(batches):
        for batch in W.slices(batches, 1):
            sets = shingle_sets([t.encode(errors="replace") for t in batch.column(1).to_pylist()], k)
            rows = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    return texts.join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, shingle long")


def _candidates(nodes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (hub, node) of different roots that may reach the threshold, from nodes (node, root, n); none that does is missing."""
    tiny = 1e-6
    step = lambda n: F.floor(F.log(n) / math.log(STEP)).cast("int")
    shingles = settle(_shingle_rows(nodes, texts, k))
    # Shingles of one node alone come first in its order and meet nobody: only how many they are matters.
    common = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    lists = shingles.join(common, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("list"))
    lists = lists.join(nodes, "node").withColumn("lone", F.col("n") - F.size("list"))
    first = F.col("n") - F.ceil(threshold * F.col("n") - tiny) + 1 - F.col("lone")
    rows = lists.where(first > 0).select("node", "root", "n", "lone", F.posexplode(F.slice("list", F.lit(1), first.cast("int"))).alias("at", "one"))
    # reach: the largest set that can share enough shingles from this one on.
    reach = F.floor((F.col("n") - F.col("lone") - F.col("at")) * ((1 + threshold) / threshold) - F.col("n") + tiny)
    rows = rows.select("node", "root", "n", F.col("one.shingle").alias("shingle"), reach.alias("reach"))
    # Of a pair the smaller set waits in its own step of sizes, and the larger one looks in all steps that it reaches.
    waiting = rows.where("reach >= n").select("*", F.lit(False).alias("looks"), step(F.col("n")).alias("step"))
    steps = F.sequence(step(F.greatest(F.ceil(threshold * F.col("n") - tiny), F.lit(1))), step(F.least("reach", "n")))
    placed = settle(waiting.unionByName(rows.select("*", F.lit(True).alias("looks"), F.explode(steps).alias("step"))))
    # Nodes of a place's most frequent root meet only those of other roots.
    by_root = placed.groupBy("shingle", "step", "root").agg(F.count(F.lit(1)).alias("many"))
    top = by_root.groupBy("shingle", "step").agg(F.max_by("root", "many").alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    placed = settle(placed.join(top.drop("roots"), ["shingle", "step"]))
    release(nodes.sparkSession)

    def meet(lookers: Column, waiters: Column) -> DataFrame:
        x = placed.where(F.col("looks") & lookers).select("shingle", "step", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("reach").alias("reach_a"))
        y = placed.where(~F.col("looks") & waiters).select("shingle", "step", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("reach").alias("reach_b"))
        fits = (F.col("ra") != F.col("rb")) & (F.col("nb") <= F.col("na")) & (F.col("nb") <= F.col("reach_a")) & (F.col("na") <= F.col("reach_b"))
        on = (x["shingle"] == y["shingle"]) & (x["step"] == y["step"])
        return x.join(y, on & fits).select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("node"))

    rare, often = F.col("root") != F.col("top"), F.col("root") == F.col("top")
    return meet(rare, F.lit(True)).unionByName(meet(often, rare)).distinct()


def classes(documents: DataFrame, signer: Signer, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id and class_id, the smallest doc_id of its class, of every document."""
    spark = documents.sparkSession
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("node"), "text")
    signed = settle(_sign(docs, signer, k))
    leads = settle(signed.groupBy("a", "b").agg(F.min("node").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    members = leads.select(F.explode("bands").alias("band"), "node", "n").dropDuplicates(["band", "node"])
    full = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum")).where("size > 1")
    full = full.groupBy("size", "low", "sum").agg(F.min("band").alias("band"))  # bands of the same nodes once
    members = settle(members.join(full.select("band", "size"), "band").select("band", "node", "n", "size"))
    release(spark)
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"), F.first("n").alias("n"))
    texts = settle(docs.select("node", "text").join(degree.select("node"), "node", "left_semi").distinct())
    # 1. Every node with the hubs of its bands.
    members = settle(members.select("band", "node").join(degree, "node"))
    chosen = members.groupBy("band").agg(F.max(F.struct("degree", F.bitwise_not("node").alias("not_node"), "n")).alias("hub"))
    chosen = chosen.select("band", F.bitwise_not("hub.not_node").alias("hub"), F.col("hub.n").alias("hub_n"))
    others = settle(members.join(chosen, "band").where("node <> hub").select("band", "node", "n", "hub", "hub_n"))
    pairs = others.where(F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
    linked = settle(_compare(pairs.select("hub", "node").distinct(), texts, k, threshold))
    release(spark)
    found = graphs.components(linked)
    # 2. The nodes of bands that aren't in one component but for the hub.
    placed = others.join(found, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    split = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    nodes = settle(placed.join(split, "band", "left_semi").groupBy("node", "root").agg(F.first("n").alias("n")))
    more = settle(_compare(_candidates(nodes, texts, k, threshold), texts, k, threshold))
    release(spark)
    if not more.isEmpty():
        found = graphs.components(linked.unionByName(more))
    ids = signed.select("doc_id", "node", "a", "b").join(leads.select("a", "b", F.col("node").alias("lead")), ["a", "b"])
    ids = ids.join(found.select(F.col("node").alias("lead"), "root"), "lead", "left")
    return ids.select("doc_id", F.coalesce("root", "lead").alias("class_id"))


def keep_one(documents: DataFrame, signer: Signer, threshold: float = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """The documents, with all their columns, less all but the first of each class; equal rows of the first count once."""
    found = settle(classes(documents, signer, threshold, k))
    name = free_name(documents, "node")
    node = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    firsts = found.select(F.col("class_id").alias(name)).distinct()
    rows = documents.withColumn(name, node).join(firsts, name, "left_semi")
    return rows.dropDuplicates([name]).select(*[f"`{c}`" for c in documents.columns])
