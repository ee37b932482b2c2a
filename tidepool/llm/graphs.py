"""Connected components of links between documents, as joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Settled, counted


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (columns a, b): root is the smallest node of its component.

    In each round every node points at its smallest neighbour if that is
    smaller; pointers are followed to their ends by doubling, and links are
    drawn anew between the ends.  At least every second end of a component
    goes in a round, so rounds and doublings grow with the logarithm of the
    component.  Rows that go to one hot node are reduced to one minimum before
    the shuffle, and skewed joins are left to adaptive execution: their other
    side has one row for each node.
    """
    edges = counted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while edges.rows:
        both = edges.frame.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        up = counted(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")))
        while True:
            over = up.side.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = counted(up.frame.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            up = Settled(jumped.frame.select("node", "root"), jumped.rows)
            if jumped.frame.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            over = up.side.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = counted(labels.frame.join(over, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        drawn = edges.frame.join(up.side.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(up.side.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = counted(drawn.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return labels.frame if labels is not None else edges.frame.select(F.col("a").alias("node"), F.col("b").alias("root"))
