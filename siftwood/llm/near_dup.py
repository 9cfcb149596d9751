"""MinHash near-duplicates: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

1. One pass over the texts keeps, of each document's set of word shingles, its
   size, a 128-bit signature and the k smallest hashes (one hash function).
2. Documents with one signature form a class; its smallest id stands for it.
3. Retained values that at least two classes hold become inverted lists. Two
   sets at or above the threshold share at least ``overlap(k)`` retained values
   (missed with a chance below 1e-7 at k = 64), so each class is only listed
   under its rarest values, as many as make one shared value certain: values
   out of common passages drop out, without any cap on a list's length.
4. In each list the union-sketch estimate links members; a list gives the
   edges of a spanning forest, never all its pairs. Long lists are dealt out as
   pairs of blocks.
5. Within each connected component of estimated links, full sets are compared,
   again with a spanning forest of exact links; large ones as pairs of blocks.
6. The connected components of the exact links are the result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .kernel import each, grams, lists
from .shared import cut, files_for, flat, groups, text_of

SHINGLE = 5
PERCENT = 75
K = 64
#: Members of a list, and shingles of an estimated component, that one task compares at once.
LIST_BLOCK = 2000
SET_BLOCK = 1_000_000
TOP = np.iinfo(np.int64).max


def overlap(k: int) -> int:
    """Retained values that two sets at the threshold share at least, for the smaller number retained."""
    return 28 if k >= 48 else -(-PERCENT * k // 100)


def shingle_sets(column: pa.Array, n: int = SHINGLE):
    """Each text's sorted distinct shingle hashes (63 bits); a text with fewer words is one shingle, without words none."""
    for _, _, w in each(column):
        h = w.hashes()
        g = (grams(h, n) >> np.uint64(1)).astype(np.int64)
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            if b - a >= n:
                yield np.unique(g[a : b - n + 1])
            elif b > a:
                short = np.concatenate([h[a:b], np.full(n - (b - a), b - a, np.uint64)])
                yield (grams(short, n, 0x9E6C63D0876A9A47) >> np.uint64(1)).astype(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    u = s.astype(np.uint64)
    x = u * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return int(u.sum(dtype=np.uint64).astype(np.int64)), int((x * np.uint64(0xA5CB9243B2E5D7B1)).sum(dtype=np.uint64).astype(np.int64))


def sketches(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n_shingles, s1, s2, sketch): a hash of the text, set size, signature and the k smallest shingle hashes in order."""

    def run(it):
        for batch in it:
            sizes, s1, s2, parts = [], [], [], []
            for s in shingle_sets(batch.column("text"), n):
                sizes.append(len(s))
                a, b = _signature(s)
                s1.append(a)
                s2.append(b)
                parts.append(s[:k].copy())
            bounds = np.cumsum([0, *map(len, parts)])
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists(bounds, values)], ["doc_id", "row", "n_shingles", "s1", "s2", "sketch"])

    return text_of(docs, _row().alias("row")).mapInArrow(run, "doc_id long, row long, n_shingles long, s1 long, s2 long, sketch array<long>")


def forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that near(p, rest) tells the neighbours of."""
    rest, edges = np.arange(count), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            p = queue.pop()
            ok = near(p, rest)
            got, rest = rest[ok], rest[~ok]
            edges += [(p, int(g)) for g in got]
            queue += map(int, got)
    return edges


def _near_by_sketch(sizes: np.ndarray, bounds: np.ndarray, values: np.ndarray, k: int, slack: float):
    held = np.diff(bounds)
    m = np.full((len(sizes), k), TOP, np.int64)
    m[np.repeat(np.arange(len(sizes)), held), np.arange(len(values)) - np.repeat(bounds[:-1], held)] = values
    #: Up to this value a sketch holds all of its set.
    known = np.where(sizes <= held, TOP, m[np.arange(len(sizes)), np.maximum(held - 1, 0)])

    def near(p: int, rest: np.ndarray) -> np.ndarray:
        mine = m[p, : held[p]]
        t = np.minimum(known[rest], known[p])
        fit = np.minimum(sizes[rest], sizes[p]) * 100 >= PERCENT * np.maximum(sizes[rest], sizes[p])
        out = np.zeros(len(rest), bool)
        if not fit.any():
            return out
        r, t = m[rest[fit]], t[fit]
        inside = (r <= t[:, None]) & (r != TOP)
        at = np.minimum(np.searchsorted(mine, r), held[p] - 1)
        shared = (inside & (mine[at] == r)).sum(1)
        union = inside.sum(1) + np.searchsorted(mine, t, "right") - shared
        out[fit] = np.where(t == TOP, 100 * shared >= PERCENT * union, shared >= slack * union)
        return out

    return near


def _near_by_set(bounds: np.ndarray, values: np.ndarray):
    _, ids = np.unique(values, return_inverse=True)
    sizes = np.diff(bounds)
    mark = np.zeros(ids.max(initial=-1) + 1, bool)

    def near(p: int, rest: np.ndarray) -> np.ndarray:
        mark[:] = False
        mark[ids[bounds[p] : bounds[p + 1]]] = True
        fit = np.minimum(sizes[rest], sizes[p]) * 100 >= PERCENT * np.maximum(sizes[rest], sizes[p])
        shared = np.zeros(len(rest), np.int64)
        if 4 * fit.sum() > len(sizes):
            total = np.concatenate([[0], np.cumsum(mark[ids])])
            shared[fit] = (total[bounds[1:]] - total[bounds[:-1]])[rest[fit]]
        else:
            shared[fit] = [mark[ids[bounds[r] : bounds[r + 1]]].sum() for r in rest[fit]]
        return fit & (100 * shared >= PERCENT * (sizes[rest] + sizes[p] - shared))

    return near


def _edges_of(nodes: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    e = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[e[:, 0]]), pa.array(nodes[e[:, 1]])], ["a", "b"])


def _in_blocks(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deals each group out as pairs (i, j) of its blocks, so that any two members meet in some pair."""
    mine = F.pmod(F.xxhash64("node"), F.col(blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return rows.withColumn("_mine", mine).withColumn("_other", other).withColumn("i", F.least("_mine", "_other")).withColumn("j", F.greatest("_mine", "_other")).drop("_mine", "_other", blocks).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def estimated_links(nodes: DataFrame, k: int = K) -> DataFrame:
    """Edges (a, b) that connect any two nodes whose sketches put them near the threshold. nodes: (node, n, sketch)."""
    slack = 0.5
    posted = nodes.select("node", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    often = posted.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    w = Window.partitionBy("node")
    need = F.when(F.col("k") >= 48, F.lit(overlap(48))).otherwise(F.ceil(F.col("k") * PERCENT / 100))
    listed = (
        posted.join(often, "v")
        .withColumn("rank", F.col("k") - F.count("*").over(w) + F.row_number().over(w.orderBy("c", "v")))
        .where(F.col("rank") <= F.col("k") - need + 1)
        .select("v", "node")
    )
    listed = cut(listed, "postings")
    same = listed.groupBy("v").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    kept = same.groupBy("m", "x", "lo", "hi").agg(F.min("v").alias("v")).select("v", F.ceil(F.col("m") / LIST_BLOCK).cast("long").alias("blocks"))
    members = listed.join(kept, "v").join(nodes, "node")

    def run(it):
        for table, bounds in groups(it, ["v", "i", "j"]):
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            at, values = flat(table.column("sketch"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    found = forest(b - a, _near_by_sketch(n[a:b], at[a : b + 1] - at[a], values[at[a] : at[b]], k, slack))
                    if found:
                        yield _edges_of(node[a:b], found)

    return _in_blocks(members, "v", "blocks").select("v", "i", "j", "node", "n", "sketch").mapInArrow(run, "a long, b long").distinct()


def exact_links(docs: DataFrame, clusters: DataFrame, nodes: DataFrame, n: int = SHINGLE) -> DataFrame:
    """Edges (a, b) that connect within each cluster what full sets link. clusters: (node, component); nodes: (node, doc_id, row, n)."""
    weighed = clusters.join(nodes, "node")
    blocks = weighed.groupBy("component").agg(F.greatest(F.ceil(F.sum("n") / SET_BLOCK), F.ceil(F.count("*") / (2 * LIST_BLOCK))).cast("long").alias("blocks"))
    texts = text_of(docs, _row().alias("row"))
    members = weighed.join(blocks, "component").join(texts, ["doc_id", "row"]).select("component", "blocks", "node", "text")

    def fill(it):
        for batch in it:
            sets = list(shingle_sets(batch.column("text"), n))
            bounds = np.cumsum([0, *map(len, sets)])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("blocks"), batch.column("node"), lists(bounds, values)], ["component", "blocks", "node", "shingles"])

    def run(it):
        for table, bounds in groups(it, ["component", "i", "j"]):
            node = table.column("node").to_numpy()
            at, values = flat(table.column("shingles"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    found = forest(b - a, _near_by_set(at[a : b + 1] - at[a], values[at[a] : at[b]]))
                    if found:
                        yield _edges_of(node[a:b], found)

    filled = members.mapInArrow(fill, "component long, blocks long, node long, shingles array<long>")
    return _in_blocks(filled, "component", "blocks").select("component", "i", "j", "node", "shingles").mapInArrow(run, "a long, b long").distinct()


def _row():
    """Tells texts of one id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _components(docs: DataFrame, k: int, n: int) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, kept), a row per document."""
    base = cut(sketches(docs, k, n), "sketches")
    full = base.where("n_shingles > 0 and doc_id is not null")
    # a node stands for a set: it is the set's smallest id, or a number of its own (below all ids) where that id has unlike texts
    twice = cut(full.groupBy("doc_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo < hi").select(F.col("doc_id").alias("twice")), "twice", 4)
    own = -F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 2) - 2**61
    full = full.join(twice, F.col("doc_id") == F.col("twice"), "left").withColumn("node", F.when(F.col("twice").isNull(), F.col("doc_id")).otherwise(own)).drop("twice")
    classes = full.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "row", "node")).alias("of")).select("s1", "s2", "n_shingles", F.col("of.node").alias("rep"), F.col("of.doc_id").alias("rep_id"))
    nodes = full.join(classes.select("rep"), full.node == F.col("rep"), "left_semi").select("node", "doc_id", "row", F.col("n_shingles").alias("n"), "sketch")
    # what follows has a row per node or link of a forest: few files hold it
    few = files_for(base.count())
    rough = cut(estimated_links(nodes, k), "estimated", few)
    clusters = cut(components(rough, files=few), "clusters", few)
    exact = cut(exact_links(docs, clusters, nodes.drop("sketch").distinct(), n), "exact", few)
    labels = components(exact, files=few)
    # the smallest id of each component; its smallest node is that id, but for nodes with numbers of their own
    ids = nodes.select("node", "doc_id").distinct()
    least = labels.join(ids, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = labels.join(least, "component").select(F.col("node").alias("rep"), "component_id")
    found = base.drop("sketch").join(classes, ["s1", "s2", "n_shingles"], "left").join(labels, "rep", "left")
    found = found.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "rep_id")).otherwise(F.col("doc_id")))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found.select("doc_id", "row", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Only ``doc_id`` and ``text`` are read; other columns, whatever their names,
    are left out. A null text is an empty one; documents without words are
    linked with nothing. Repeated rows are copies. Unlike texts of one id are
    linked only as their sets are, so rows of an id can be in several groups. A row without an id is linked with nothing, has a
    null component_id and is kept. An empty table gives an empty result.

    Sets are told equal by their size and 128 bits taken over the full sets; all
    other links are confirmed on the sets themselves.
    """
    return _components(docs, k, n).drop("row")


def drop_near_duplicates(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, of which each group keeps its smallest doc_id.

    Unlike texts of the id that stays all stay, but for those that are in another
    id's group; of rows with that id and one text, one stays (the smallest by its
    other columns, as JSON). Rows without an id all stay. The same rows stay
    however they are dealt out.
    """
    held, row, place = "__siftwood_doc__", "__siftwood_row__", "__siftwood_place__"
    kept = _components(docs, k, n).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(held), F.col("row").alias(row)).agg(F.count("*").alias("n"))
    kept = cut(kept, "kept")
    on = lambda t: (F.col("doc_id") == t[held]) & (_row() == t[row])
    again = kept.where("n > 1")
    if not again.limit(1).count():
        return docs.join(kept, on(kept), "left_semi").unionByName(docs.where("doc_id is null"))
    once = kept.where("n = 1")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    ranked = docs.join(again, on(again), "left_semi").withColumn(row, _row()).withColumn(place, F.row_number().over(Window.partitionBy("doc_id", row).orderBy(order)))
    return docs.join(once, on(once), "left_semi").unionByName(ranked.where(F.col(place) == 1).drop(row, place)).unionByName(docs.where("doc_id is null"))
