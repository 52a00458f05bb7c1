"""Checks that run at intervals."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import overquota


def transfers_to_close(transfers, users, folders=None, shared: bool = False):
    """Over-quota transfers with the error they are closed with, or None if there is nothing to look at: transfers without a
    size limit are left alone and, unless several nodes share the tables, so is a single connection. transfers: as for
    ``overquota``, with connection_id and has_size_limit."""
    if not shared and transfers.select("connection_id").distinct().limit(2).count() < 2:
        return None
    over = overquota(transfers.where("has_size_limit"), users, folders)
    return over.withColumn("error", F.when(F.col("kind") == "download", "read quota exceeded").otherwise("quota exceeded"))


def check_transfers(spark: SparkSession, load, close, checkpoint: str, every: str = "60 seconds", shared: bool = False):
    """A query that checks the running transfers at each tick: load() returns transfers, users and folders (or None) as they are
    then, close(df, epoch) gets the transfers to close. A tick that comes late is not made up for."""

    def run(batch, epoch: int) -> None:
        found = transfers_to_close(*load(), shared=shared)
        if found is not None:
            close(found, epoch)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every)
