"""Repeated passages by sparse suffix arrays.

Of each text's suffixes only those at minimiser positions are kept: the word at
which the least hash of KEY words lies in some window of WINDOW of them, so
that a passage of MIN_WORDS words holds the same ones wherever it stands.
Suffixes whose first KEY words some other document has are sorted by what
follows them, and again, from the word before on, by what precedes them.
Comparing neighbours in the two orders gives how far matches extend to the right
and to the left. Any MIN_WORDS words around a key are r words right of it and
SIDE - r left of it: suffixes that hold the same ones lie in one stretch of
neighbours that agree on r words in the one order, and in one that agree on
SIDE - r words in the other. So for every r the pairs of stretches are compared,
not only next neighbours, and no match is lost between others that are longer to
one side. What is found is merged into each document's spans.

A key that more than RUN suffixes start with would make one long run: their
passages are grouped by digest instead, which is aggregated before the shuffle.
Word hashes have 32 bits there and 64 in keys and digests; a chance match needs
all words of a passage but one to be equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import each, grams, mix, powers
from .shared import cut, flat, groups, text_of

MIN_WORDS = 50
KEY = 8
#: Windows of this many keys lie in any MIN_WORDS words.
WINDOW = MIN_WORDS - KEY + 1
#: Words around a key that are in MIN_WORDS words with it.
SIDE = MIN_WORDS - KEY
#: Suffixes of one key that one task sorts and compares at once, at most: about 100 MB and a second.
RUN = 100_000
_POSITION = np.uint64((1 << 28) - 1)
_BASE = 0x5851F42D4C957F2D


def anchors(g: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which MIN_WORDS words of one text start, and the word among them at which their least key does; g has all keys."""
    if len(g) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = (g & ~_POSITION) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - span)], least[WINDOW - span :])
    inside = np.zeros(len(least) + 1, np.int8)
    full = np.diff(bounds) >= MIN_WORDS
    np.add.at(inside, bounds[:-1][full], 1)
    np.add.at(inside, bounds[1:][full] - MIN_WORDS + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    return start, (least[start] & _POSITION).astype(np.int64)


def minimisers(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which the kept suffixes start, and their keys."""
    g = grams(h, KEY)
    at = np.unique(anchors(g, bounds)[1])
    return at, (g[at] >> np.uint64(1)).astype(np.int64)


def _digests(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Digests of the MIN_WORDS words from each start: a polynomial over their hashes."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(_BASE, len(h)), dtype=np.uint64)])
    back = powers(pow(_BASE, -1, 2**64), len(h))
    return mix((total[start + MIN_WORDS] - total[start]) * back[start]).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text) of the rows with an id; row tells texts of one id apart."""
    return text_of(docs, F.xxhash64(F.col("text").cast("string")).alias("row")).where("doc_id is not null")


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, key): the suffixes that are kept of texts with an id; pos counts words."""

    def run(it):
        for batch in it:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            for i, j, w in each(batch.column("text")):
                at, key = minimisers(w.hashes(), w.bounds)
                doc = np.searchsorted(w.bounds, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc], pa.int64()), pa.array(rows[i:j][doc], pa.int64()), pa.array(at - w.bounds[doc], pa.int64()), pa.array(key)], ["doc_id", "row", "pos", "key"])

    return _rows(docs).mapInArrow(run, "doc_id long, row long, pos long, key long")


def _held(matched: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, row, text, held): texts with the positions of their matched suffixes."""
    listed = matched.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("held"))
    return _rows(docs).join(listed, ["doc_id", "row"]).select("doc_id", "row", "text", "held")


def _each_held(batch: pa.RecordBatch):
    """Range of rows, words and their hashes, and the words that matched suffixes start at."""
    ends, pos = flat(batch.column("held"))
    for i, j, w in each(batch.column("text")):
        yield i, j, w, w.hashes(), pos[ends[i] : ends[j]] + np.repeat(w.bounds[:-1], np.diff(ends[i : j + 1]))


def _side(h: np.ndarray, first: np.ndarray, step: int, edge: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """SIDE words from each first one on, in the direction of step and not beyond edge, as bytes; and how many there are."""
    n = np.clip((edge - first) * step, 0, SIDE)
    at = first[:, None] + step * np.arange(SIDE)
    said = np.where(np.arange(SIDE) < n[:, None], h[np.clip(at, 0, max(len(h) - 1, 0))], 0).astype(">u4")
    offsets = np.arange(len(first) + 1, dtype=np.int32) * (4 * SIDE)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(said.tobytes())]), n


def _contexts(matched: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, doc_id, row, pos, behind, ahead, left, right): matched suffixes with the words before (backwards) and after their keys."""

    def run(it):
        for batch in it:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            for i, j, w, h, at in _each_held(batch):
                if not len(at):
                    continue
                doc = np.searchsorted(w.bounds, at, "right") - 1
                key = (grams(h, KEY)[at] >> np.uint64(1)).astype(np.int64)
                low = (h >> np.uint64(32)).astype(np.uint32)
                ahead, right = _side(low, at + KEY, 1, w.bounds[1:][doc])
                behind, left = _side(low, at - 1, -1, w.bounds[:-1][doc] - 1)
                for a in range(0, len(at), 8192):
                    part = slice(a, a + 8192)
                    cols = [pa.array(key[part]), pa.array(ids[i:j][doc][part], pa.int64()), pa.array(rows[i:j][doc][part], pa.int64()), pa.array((at - w.bounds[doc])[part], pa.int64()), behind[part], ahead[part], pa.array(left[part].astype(np.int32)), pa.array(right[part].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "row", "pos", "behind", "ahead", "left", "right"])

    return _held(matched, docs).mapInArrow(run, "key long, doc_id long, row long, pos long, behind binary, ahead binary, left int, right int")


def _agree(key: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Of neighbours in an order, the number of leading words that each shares with the one before; -1 where another key begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    same = side[1:] == side[:-1]
    shared = np.where(same.all(1), SIDE, same.argmin(1))
    return np.concatenate([[-1], np.where(key[1:] == key[:-1], shared, -1)])


def shared_passages(key: np.ndarray, doc: np.ndarray, behind: np.ndarray, ahead: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order of (key, ahead): which splits r of MIN_WORDS words other documents have too, and the smallest of these documents.

    Split r is r words after the key and SIDE - r before it. Both results have a row for each suffix and a column for each r.
    """
    m = len(key)
    found, first = np.zeros((m, SIDE + 1), bool), np.zeros((m, SIDE + 1), np.int64)
    joined = np.concatenate([key.astype(">i8").view(np.uint8).reshape(m, 8), behind.view(np.uint8).reshape(m, 4 * SIDE)], 1)
    order = np.argsort(np.ascontiguousarray(joined).view(f"V{joined.shape[1]}").ravel(), kind="stable")
    forth, back = _agree(key, ahead), _agree(key[order], behind[order])
    most_forth = np.maximum(forth, np.append(forth[1:], -1))
    most_back = np.empty(m, np.int64)
    most_back[order] = np.maximum(back, np.append(back[1:], -1))
    stretch = np.empty(m, np.int64)
    for r in range(SIDE + 1):
        live = np.flatnonzero((most_forth >= r) & (most_back >= SIDE - r) & (right >= r) & (left >= SIDE - r))
        if len(live) < 2:
            continue
        stretch[order] = np.cumsum(back < SIDE - r)
        pair = np.cumsum(forth < r)[live] * np.int64(m + 1) + stretch[live]
        by = np.argsort(pair, kind="stable")
        live, pair = live[by], pair[by]
        starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        least, most = np.minimum.reduceat(doc[live], starts), np.maximum.reduceat(doc[live], starts)
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(live))))
        some = (least < most)[of]
        found[live[some], r], first[live[some], r] = True, least[of][some]
    return found, first


def _neighbours(contexts: DataFrame) -> DataFrame:
    """(doc_id, row, start, last, first): MIN_WORDS words from start, and from each word up to last, that other documents have."""

    def run(it):
        for table, _ in groups(it, ["key"]):
            table = table.combine_chunks()
            key, doc, row, pos, left, right = (table.column(c).to_numpy() for c in ("key", "doc_id", "row", "pos", "left", "right"))
            behind, ahead = (np.frombuffer(b"".join(table.column(c).to_pylist()), ">u4").reshape(-1, SIDE) for c in ("behind", "ahead"))
            found, first = shared_passages(key, doc, behind, ahead, left, right)
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            of, a = np.nonzero(edge == 1)
            b = np.nonzero(edge == -1)[1] - 1
            if len(of):
                # the ranges a..b of one suffix lie apart, so the flat bounds rise
                width = SIDE + 1
                cuts = np.stack([of * width + a, of * width + b + 1], 1).ravel()
                least = np.minimum.reduceat(np.append(first.ravel(), 0), cuts)[::2]
                start = pos[of] - SIDE
                yield pa.RecordBatch.from_arrays([pa.array(doc[of]), pa.array(row[of]), pa.array(start + a), pa.array(start + b), pa.array(least)], ["doc_id", "row", "start", "last", "first"])

    dealt = contexts.repartition("key").sortWithinPartitions("key", "ahead")
    return dealt.mapInArrow(run, "doc_id long, row long, start long, last long, first long")


def _grouped(matched: DataFrame, docs: DataFrame) -> DataFrame:
    """The same for the suffixes of hot keys: all MIN_WORDS words whose least key is such a suffix's, grouped by digest."""

    def run(it):
        for batch in it:
            ids, rows = (batch.column(c).to_numpy() for c in ("doc_id", "row"))
            for i, j, w, h, own in _each_held(batch):
                kept = np.zeros(len(h), bool)
                kept[own] = True
                start, at = anchors(grams(h, KEY), w.bounds)
                start = start[kept[at]]
                doc = np.searchsorted(w.bounds, start, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc], pa.int64()), pa.array(rows[i:j][doc], pa.int64()), pa.array(start - w.bounds[doc], pa.int64()), pa.array(_digests(h, start))], ["doc_id", "row", "start", "digest"])

    passages = cut(_held(matched, docs).mapInArrow(run, "doc_id long, row long, start long, digest long"), "passages")
    shared = passages.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    # read back, so that a hot digest's side of the join can be split
    return passages.join(cut(shared, "shared"), "digest").select("doc_id", "row", "start", F.col("start").alias("last"), "first")


def repeated_passages(docs: DataFrame, run: int = RUN) -> DataFrame:
    """Spans that other documents have too: doc_id, start, words, first_doc_id; start and words count words.

    A span is a union of MIN_WORDS words each that some other document has too;
    ``first_doc_id`` is the smallest id of those and its own.
    Letter case of A-Z and white space don't count. Rows without an id or with
    fewer words give nothing, nor do repeats within one document. Rows that
    share an id are one document; each of its texts has spans of its own, and
    equal rows have them once. Only ``doc_id`` and ``text`` are read. An empty
    table gives an empty result.
    """
    often = suffixes(docs).groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    often = cut(often.select("key", (F.col("n") > run).alias("hot")), "keys")  # read back, so that a hot key's side of the join can be split
    matched = suffixes(docs)
    spans = _neighbours(_contexts(matched.join(often.where("not hot"), "key", "left_semi"), docs))
    if often.where("hot").limit(1).count():
        spans = spans.unionByName(_grouped(matched.join(often.where("hot"), "key", "left_semi"), docs))
    w = Window.partitionBy("doc_id", "row").orderBy("start", "last")
    end = F.col("last") + MIN_WORDS
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", F.coalesce(upto < F.col("start"), F.lit(True)).cast("long")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("words"), F.min("first").alias("first_doc_id")).drop("row", "run")
