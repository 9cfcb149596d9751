"""Tables that several branches of a plan read."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df computed once: a checkpoint in the folder that the session names, or cached (and computed again where it is lost) if it names none."""
    context = df.sparkSession.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
