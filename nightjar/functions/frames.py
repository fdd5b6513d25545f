"""Small tables beside large ones."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A dimension held and counted once, with a broadcast hint if it has at most ``most`` rows; else it is joined by shuffle."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(held) if held.count() <= most else held


def once(column: Column) -> Column:
    """A costly column to select, worked out once a row: filters on it, which Catalyst would else push below it and paste it into, stay above."""
    return F.explode(F.array(column))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the folder of spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset a temporary folder is set on one machine; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)
