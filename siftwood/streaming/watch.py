"""Watching: changed files are scanned as they come, and merged with what is known."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import incremental
from ..plans.scan import scan


def changes(spark: SparkSession, root: str, schema: str = "path string, content string, ts timestamp", fmt: str = "parquet") -> DataFrame:
    """A stream of file versions that arrive under root. Deletions never come as files: compare snapshots for those."""
    return spark.readStream.format(fmt).schema(schema).load(root)


def debounced(stream: DataFrame, gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Bursts of changes; a burst is given out once its quiet period and the lateness have passed."""
    return incremental.sessions(stream.withColumn("item", F.col("path")), gap, "ts", "item", late)


def watch(stream: DataFrame, cache: str, checkpoint: str, mode: str = "full", every: str = "2 seconds", then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Scan each batch's files (their latest versions) and merge the findings into the table at cache.

    A batch writes a table of its own under cache, named by its number, and a
    file's findings are those of its last batch: a batch that runs again
    overwrites its own table only, so no finding is lost or comes twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("path").agg(F.max_by("content", "ts").alias("content"))
        latest.select("path").write.mode("overwrite").parquet(f"{cache}/paths/batch={number}")
        found = scan(latest, mode=mode, reduce=False)
        found.write.mode("overwrite").parquet(f"{cache}/findings/batch={number}")
        if then:
            then(found, number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def current(spark: SparkSession, cache: str) -> DataFrame:
    """The findings of each file's last batch."""
    last = spark.read.parquet(f"{cache}/paths").groupBy(F.col("path").alias("file_path")).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{cache}/findings").join(last, ["file_path", "batch"], "left_semi").drop("batch")
