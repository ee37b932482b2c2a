"""A stream of changes into an engine: one micro-batch, one version.

The stream carries, for one table, ``seq`` (the order of changes), ``op`` (I, U
or D), the key, and ``row``, a struct of the table's columns (null for a
delete).  A micro-batch is composed to one change for each key, given its
before-images, and committed whole.  Of the table only the rows with the
micro-batch's keys are joined; a micro-batch of bounded size is broadcast, so
the table isn't shuffled.

A micro-batch that comes again after a failure is not applied again, also when
the database has been opened anew: its number is committed with its changes,
under the identity that the stream's checkpoint gives it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators import deltas
from ..plans.lower import bounded
from ..schema import Table


def feed_schema(table: Table) -> T.StructType:
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", table.schema[table.key].dataType), T.StructField("row", table.schema)])


def last_images(feed: DataFrame) -> DataFrame:
    """key, after: what the last change of each key leaves."""
    after = F.when(F.col("op") != deltas.DELETE, F.col("row"))
    return feed.groupBy("key").agg(F.max_by(F.struct(after.alias("after")), "seq").alias("x")).select("key", F.col("x.after").alias("after"))


def batch_of(engine: Engine, name: str, last: DataFrame, rows: int | None = None) -> DataFrame:
    """The batch of some last images against the table as it is; rows: how many there are, if that is known."""
    table = engine.catalog.table(name)
    touched = deltas.images(engine.tables[name], table.key).join(bounded(last.select("key"), rows), "key", "left_semi")
    return deltas.from_images(last.join(bounded(touched.select("key", F.col("row").alias("before")), rows), "key", "left").select("key", "before", "after"))


class Feed:
    """Feeds an engine's table from a stream; stream: by what name the database knows it, where it isn't started here."""

    def __init__(self, engine: Engine, name: str, stream: str | None = None):
        self.engine, self.name, self.stream = engine, name, stream or f"changes of {name}"
        self._checkpoint: str | None = None

    def _identity(self) -> str:
        if self._checkpoint:
            said = self.engine.store.text(f"{self._checkpoint}/metadata")
            if said:
                self.stream, self._checkpoint = json.loads(said.splitlines()[-1])["id"], None
        return self.stream

    def apply(self, frame: DataFrame, number: int) -> None:
        """One micro-batch."""
        stream = self._identity()
        if number <= self.engine.store.stream_at(stream):
            return
        last = last_images(frame).persist()
        batch = None
        try:
            rows = last.count()
            # The batch is used for the table and for each subscription; its before-images must be those of now.
            batch = batch_of(self.engine, self.name, last, rows).persist()
            self.engine.apply_changes({} if batch.isEmpty() else {self.name: batch}, (stream, number))
        finally:
            if batch is not None:
                batch.unpersist()
            last.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the query; trigger: as for ``writeStream.trigger``."""
        self._checkpoint = checkpoint.rstrip("/")
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
