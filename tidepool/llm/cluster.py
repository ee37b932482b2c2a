"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import checkpoints


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, read by Spark only, so any store that Spark knows will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def settle(frame: DataFrame) -> DataFrame:
    """The frame with its rows in the shared checkpoint folder, made by executors that have this library."""
    ship(frame.sparkSession)
    return checkpoints.settle(frame)


#: Rows of a few numbers each that count as a small table: it may be broadcast, and needs few tasks.
SMALL_ROWS = 200_000


@dataclass
class Settled:
    """A settled table of a few numeric columns with its number of rows; a small one is read by a few tasks."""

    frame: DataFrame
    rows: int

    @property
    def side(self) -> DataFrame:
        """For joins: to be broadcast if it is small, else as it is."""
        return F.broadcast(self.frame) if self.rows <= SMALL_ROWS else self.frame


def counted(frame: DataFrame) -> Settled:
    done = settle(frame)
    rows = done.count()
    return Settled(done.coalesce(8) if rows <= SMALL_ROWS else done, rows)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now, not when the driver happens to collect its garbage.

    Plans let go of their shuffles one collection after Python lets go of the plans, so there are a few.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


_shipped: set[str] = set()

#: Bytes of rows that go to a worker at once, whatever the texts' lengths: both sides hold some copies of them beside the heap.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors, whose Python may not have it, once for each application; bounds what goes to a worker at once, if the application has no bound of its own."""
    if not spark.sparkContext.getConf().contains(BATCH[0]):
        spark.conf.set(*BATCH)
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[1]
    if app in _shipped or not root.is_dir():
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def pick(frame: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that further columns of any name can't clash; an absent one is null."""
    ship(frame.sparkSession)
    have = set(frame.columns)
    return frame.select(*[F.col(f"`{n}`") if n in have else F.lit(None).alias(n) for n in names])


def free_name(frame: DataFrame, name: str) -> str:
    """The name, or one made from it that no column has."""
    while name in frame.columns:
        name += "_"
    return name
