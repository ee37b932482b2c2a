"""Changes to keyed tables, as DataFrames.

A change has a key and two images, ``before`` and ``after``, structs of the
table's columns; a missing image is null.  A batch has one change for each key
at most, and none whose images are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates
from ..plans import ir

INSERT, UPDATE, DELETE = "I", "U", "D"


def schema(table: T.StructType, key: str) -> T.StructType:
    """Of a batch over a table."""
    return T.StructType([T.StructField("key", table[key].dataType), T.StructField("before", table), T.StructField("after", table)])


def kind() -> Column:
    """Insert, update or delete, of a change."""
    return F.when(F.col("before").isNull(), INSERT).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)


def from_images(changes: DataFrame) -> DataFrame:
    """Drops what isn't a change: no image at all, or equal ones."""
    return changes.where(~F.col("before").eqNullSafe(F.col("after")))


def images(rows: DataFrame, key: str) -> DataFrame:
    """key, row: a table's rows as structs."""
    return rows.select(F.col(f"`{key}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))


def inserts(rows: DataFrame, key: str) -> DataFrame:
    """A table as the batch that makes it from nothing."""
    row = images(rows, key)
    return row.select("key", F.lit(None).cast(row.schema["row"].dataType).alias("before"), F.col("row").alias("after"))


def compose(changes: DataFrame, order: str = "seq") -> DataFrame:
    """Successive changes as one batch: the first before, the last after, nothing where they are equal.

    Nulls at either end are kept; partial minima and maxima are taken before
    the shuffle, so a key changed very often is no burden.
    """
    edges = changes.groupBy("key").agg(F.min_by(F.struct("before"), order).alias("first"), F.max_by(F.struct("after"), order).alias("last"))
    return from_images(edges.select("key", F.col("first.before").alias("before"), F.col("last.after").alias("after")))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The batch that turns one keyed table into another."""
    a = images(old, key).select("key", F.col("row").alias("before"))
    b = images(new, key).select("key", F.col("row").alias("after"))
    return from_images(a.join(b, "key", "full_outer").select("key", "before", "after"))


def apply(rows: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The table with a batch applied; a change for a key that isn't there, or is there already, does what its after-image says."""
    kept = rows.join(batch.select(F.col("key").alias("changed_")), F.col(f"`{key}`") == F.col("changed_"), "left_anti")
    return kept.unionByName(batch.where("after IS NOT NULL").select("after.*"))


def to_zset(batch: DataFrame) -> DataFrame:
    """key, row, weight: each before-image once less, each after-image once more."""
    pair = F.array(F.struct(F.col("before").alias("row"), F.lit(-1).alias("weight")), F.struct(F.col("after").alias("row"), F.lit(1).alias("weight")))
    return batch.select("key", F.explode(pair).alias("x")).where("x.row IS NOT NULL").select("key", "x.row", "x.weight")


def from_zset(weighted: DataFrame) -> DataFrame:
    """A batch from weighted rows: rows of weight below zero are before-images, above zero after-images."""
    net = weighted.groupBy("key", "row").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    return from_images(net.groupBy("key").agg(F.max(F.when(F.col("weight") < 0, F.col("row"))).alias("before"), F.max(F.when(F.col("weight") > 0, F.col("row"))).alias("after")))


# -- stateless operators: each image on its own, then no-ops away


def filter_changes(batch: DataFrame, predicate: ir.Predicate, params: tuple = ()) -> DataFrame:
    """The predicate over changes: a row that stops matching is deleted, one that starts is inserted."""

    wide = batch.select("key", "before", "after", *[F.col(f"{s}.`{c}`").alias(f"{s}__{c}") for s in ("before", "after") for c in batch.schema[s].dataType.names])
    kept = wide
    for side in ("before", "after"):
        inner = batch.schema[side].dataType
        renamed = T.StructType([T.StructField(f"{side}__{f.name}", f.dataType) for f in inner])
        holds = predicates.lower(_renamed(predicate, f"{side}__"), renamed, params)
        kept = kept.withColumn(side, F.when(holds & F.col(side).isNotNull(), F.col(side)))
    return from_images(kept.select("key", "before", "after"))


def _renamed(predicate, prefix: str):
    """The predicate with every column's name prefixed."""
    e = lambda x: ir.Col(prefix + x.name) if isinstance(x, ir.Col) else x
    match predicate:
        case ir.Cmp(left, op, right):
            return ir.Cmp(e(left), op, e(right))
        case ir.In(left, values):
            return ir.In(e(left), values)
        case ir.Between(left, low, high):
            return ir.Between(e(left), e(low), e(high))
        case ir.IsNull(x):
            return ir.IsNull(e(x))
        case ir.IsNotNull(x):
            return ir.IsNotNull(e(x))
        case ir.Prefix(left, prefix_):
            return ir.Prefix(e(left), prefix_)
        case ir.And(parts):
            return ir.And(tuple(_renamed(p, prefix) for p in parts))
        case ir.Or(parts):
            return ir.Or(tuple(_renamed(p, prefix) for p in parts))
        case ir.Not(part):
            return ir.Not(_renamed(part, prefix))
    return predicate


def project_changes(batch: DataFrame, columns: list[str]) -> DataFrame:
    """Some of the columns, in this order; what changes in others only is no change.  A column that isn't there is null."""

    def image(side: str) -> Column:
        have = batch.schema[side].dataType.names
        fields = [(F.col(f"{side}.`{c}`") if c in have else F.lit(None)).alias(c) for c in columns]
        return F.when(F.col(side).isNotNull(), F.struct(*fields)).alias(side)

    return from_images(batch.select("key", image("before"), image("after")))


def union_changes(*batches: DataFrame) -> DataFrame:
    """Batches over disjoint keys as one."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out
