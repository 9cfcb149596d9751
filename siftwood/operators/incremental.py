"""What changed, and what must be scanned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def snapshot(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): new, changed and deleted paths between two snapshots, by one full outer join."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    what = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", what.alias("change")).where("change is not null")


def modified_since(files: DataFrame, last_scan: Column) -> DataFrame:
    return files.where(F.col("modification_time") > last_scan)


def merge(fresh: DataFrame, cached: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Fresh findings of changed files, and cached ones of all other files."""
    return fresh.unionByName(cached.join(changed_paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*fresh.columns))


def sessions(events: DataFrame, gap: str = "5 minutes", ts: str = "ts", item: str = "item", watermark: str | None = None) -> DataFrame:
    """Bursts of changes that quiet periods of ``gap`` part: start, end, n, items. Works on streams with a watermark as well."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    w = F.session_window(F.col(ts), gap)
    # streams want a key beside the session; whether there is an item is the same for all but rows without one
    keys = [w.alias("w"), F.col(item).isNull().alias("none")] if watermark else [w.alias("w")]
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "items")


def write_cache(found: DataFrame, path: str) -> None:
    """The findings by detector, with the version of their schema."""
    found.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").partitionBy("detected_by").parquet(path)


def read_cache(spark, path: str) -> DataFrame:
    """Cached findings; those of another schema version count as absent."""
    return spark.read.parquet(path).where(F.col("schema_version") == SCHEMA_VERSION).drop("schema_version")
