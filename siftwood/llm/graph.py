"""Connected components of a graph of any size, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, files_for


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """Nodes of ``edges`` with the smallest node that each can reach: (node, component).

    Alternates the large-star and the small-star operation until the edges no
    longer change. Each round is written to the shared folder, so the lineage
    stays one round deep. A node with many edges is only ever reduced to its
    minimum, and joined with that one row; the minima are read back from a
    table, so that the join is a broadcast if they are few, and otherwise the
    edges of such a node can be split over tasks.
    """
    now = cut(_oriented(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))), "edges", files)
    said = _state(now)
    while said[0]:
        files = files_for(said[0])
        large = cut(_large_star(now, files), "edges", files)
        new = cut(_small_star(large, files), "edges", files)
        drop(now)
        drop(large)
        now, before = new, said
        said = _state(now)
        if said == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node to its smaller one."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least", files)
    return _oriented(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "least", files)
    return _oriented(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
