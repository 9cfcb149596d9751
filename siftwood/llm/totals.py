"""Dense totals of bounded width over a whole corpus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1024


def dense_totals(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None] | None, width: int, kind: type = np.int64, begin: Callable | None = None) -> np.ndarray:
    """The sum over all batches of the vector that count(batch, vector) adds to.

    ``begin``, if given, is called at the start of each task and returns that
    task's count and what is called with the vector at its end.

    Each task sends its vector once, in slices without those that are all zero;
    slices meet by their number, in the order of the tasks, so that sums of
    floats are the same in every run. Only the one vector of ``width`` items
    reaches the driver.
    """

    def gather(it):
        import zlib

        from pyspark import TaskContext

        total = np.zeros(-(-width // SLICE) * SLICE, kind)
        step, end = begin() if begin else (count, None)
        for batch in it:
            step(batch, total[:width])
        if end:
            end(total[:width])
        full = np.flatnonzero(total.reshape(-1, SLICE).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(full), pa.int64()), pa.array([zlib.compress(total[k * SLICE : (k + 1) * SLICE].tobytes(), 1) for k in full], pa.binary())], ["slice", "task", "part"])

    def add(it):
        import zlib

        total: dict[int, np.ndarray] = {}
        for batch in it:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                x = np.frombuffer(zlib.decompress(part.as_py()), kind)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "part"])

    parts = df.mapInArrow(gather, "slice long, task long, part binary").repartition("slice").sortWithinPartitions("slice", "task").mapInArrow(add, "slice long, part binary")
    out = np.zeros(-(-width // SLICE) * SLICE, kind)
    for row in parts.collect():
        out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["part"], kind)
    return out[:width]
