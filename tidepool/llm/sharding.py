"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

A row descends the tree.  At each node every child draws ``-ln(u) / weight``,
with u hashed from the child's name and the row's key, and the smallest draw
wins: children get rows in proportion to their weights, and a child whose
weight didn't change never loses a row to a sibling that didn't gain.  A change
of weight therefore moves rows only into or out of the subtree that changed.

One more shard is a region of its own, so ``grow`` moves rows into it and
nowhere else.  The law is ``key``: the row's number and the shard count decide.

All of it is Spark expressions.  Rows are numbered within a shard in hash
buckets of number and content, so no task holds a whole shard.

Defined results: a null text has no bytes and crc32 0; rows with a null key all
go where the null key hashes; repeated rows go to one shard and get slots of
their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import pick, settle

#: Parts into which a shard is split for numbering its rows.
BUCKETS = 4096


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or a group of nodes; a group weighs what its children weigh."""

    name: str
    own_weight: float = 0.0
    shard: int | None = None
    children: tuple[Node, ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def leaf(number: int, weight: float = 1.0) -> Node:
    return Node(f"shard-{number}", weight, number)


def region(number: int, racks: list[list[Node]]) -> Node:
    return Node(f"region-{number}", children=tuple(Node(f"region-{number}/rack-{i}", children=tuple(x)) for i, x in enumerate(racks)))


def topology(shards: int = 8, racks: int = 2, rack_shards: int = 2) -> Node:
    """Regions of ``racks`` racks of ``rack_shards`` shards; shards beyond the last full region are regions of their own."""
    each = racks * rack_shards
    regions = [region(r, [[leaf(r * each + k * rack_shards + s) for s in range(rack_shards)] for k in range(racks)]) for r in range(shards // each)]
    tree = Node("root", children=tuple(regions))
    for _ in range(shards % each):
        tree = grow(tree)
    return tree


def shards_of(tree: Node) -> list[Node]:
    return [tree] if tree.shard is not None else [x for c in tree.children for x in shards_of(c)]


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, as a region of its own: no other node's weight changes but the root's."""
    number = max((x.shard for x in shards_of(tree)), default=-1) + 1
    return Node(tree.name, children=(*tree.children, region(len(tree.children), [[leaf(number, weight)]])))


def draw(node: Node, key: Column) -> Column:
    """Small if the node should win; exponential with the node's weight as its rate."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.ln(u) / F.lit(float(node.weight))


def _winner(node: Node, key: Column) -> Column:
    live = [(i, c) for i, c in enumerate(node.children) if c.weight > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.array_min(F.array(*[F.struct(draw(c, key).alias("draw"), F.lit(i).alias("child")) for i, c in live]))["child"]


def place(rows: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Adds the column ``out``: the shard of each row.  One projection for each level of the tree."""
    level, at, step = [(tree, None)], None, 0
    names = []
    while any(n.children for n, _ in level):
        step += 1
        name = f"{out}_level_{step}"
        names.append(name)
        choice, below = None, []
        for number, (node, _) in enumerate(level):
            if node.children:
                mine = _winner(node, F.col(key)) + F.lit(len(below))
                below += [(c, None) for c in node.children]
            else:
                mine = F.lit(len(below))
                below.append((node, None))
            choice = mine if at is None else (F.when if choice is None else choice.when)(F.col(at) == number, mine)
        rows = rows.withColumn(name, choice)
        level, at = below, name
    numbers = F.array(*[F.lit(n.shard) for n, _ in level])
    return rows.withColumn(out, F.get(numbers, F.col(at)).cast("int")).drop(*names)


def shard(documents: DataFrame, tree: Node | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    tree = tree or topology()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = place(place(rows, "doc_id", tree, "shard"), "doc_id", grow(tree), "grown_shard")
    rows = settle(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(own) - 1).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")
