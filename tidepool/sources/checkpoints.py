"""Cutting lineage in storage that every executor shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

from ..errors import StoreError


def settle(frame: DataFrame) -> DataFrame:
    """The frame with its rows written to the shared folder in spark.checkpoint.dir; what led to them is never run again.

    Where a session on one machine names no folder, as in tests, one is set; on a
    cluster that is an error, since executors don't share their disks.
    """
    spark = frame.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.split("[")[0] == "local":
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    done = frame.checkpoint()._jdf
    # A checkpoint keeps its plan's size estimate, a product over all joins so far; in a loop those numbers outgrow the driver.
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
