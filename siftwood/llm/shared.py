"""Tables in the folder that all executors share, and helpers on DataFrames."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on one machine, as in tests, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwood-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/siftwood/{what}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before
            return


def files_for(rows: int) -> int:
    """Files for a table of so many small rows."""
    return max(4, -(-rows // 200_000))


def cut(df: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    ``files`` bounds the number of files where the rows' number is known to be small.
    """
    spark = df.sparkSession
    if files:
        df = df.coalesce(files)
    df.write.parquet(path := fresh(spark, what))
    out = spark.read.schema(df.schema).parquet(path)
    out._siftwood_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that cut() wrote and that nothing will read again."""
    if path := getattr(df, "_siftwood_path", None):
        remove(df.sparkSession, path)


def text_of(df: DataFrame, *more: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Only doc_id and text (and ``more``), as bigint and string, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def batches(fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    def run(it):
        for batch in it:
            yield from fn(batch)

    return run


def groups(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the groups' bounds in them, out of batches that are sorted by ``keys``.

    Only the group that a batch ends in is carried to the next batch.
    """
    rest: pa.Table | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        rest = table.slice(bounds[-2])
    if rest is not None:
        rest = rest.combine_chunks()
        yield rest, _bounds(rest, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and flat values of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_list(column.type.value_type))
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return bounds - bounds[0], values[bounds[0] : bounds[-1]]
