"""Substring dedup by content-defined chunks.

A gear hash rolls over each text's words: it is shifted and the next word's code
is added, and KEY words count. A chunk begins where the hash is the least of
some window of WINDOW of them (a fixed pattern of its bits could stay out for
long), so bounds depend on the words near them only, and
insertions move no others. Any passage that two documents share is cut alike in
both between the first and the last such word of its own windows. A stretch of
adjacent chunks, as few as have MIN_WORDS words, is a repeat if some other
document has it too; runs of overlapping or adjacent repeats are what the
operator reports and removes (everywhere but in the document of smallest id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import buffers, each, gear, mix, powers, words
from .shared import cut, text_of

KEY = 4
#: Words of a chunk, at most, but for a text's last; half as many on average.
WINDOW = 10
#: Whole chunks cover a passage but for WINDOW - 1 words before them and WINDOW + KEY - 1 after, at most: 28 words of any 50, so none is missed.
MIN_WORDS = 18
ROW = "__siftwood_row__"
_POSITION = np.uint64((1 << 28) - 1)
_ONE, _TWO = 0x5851F42D4C957F2D, 0x14057B7EF767814F | 1


def _chunks(w) -> tuple[np.ndarray, np.ndarray]:
    """First words of the chunks, and each text's range of chunks."""
    first = np.zeros(len(w.starts), bool)
    first[w.bounds[:-1][w.counts > 0]] = True
    least = gear(w.hashes(), KEY)
    if len(least) >= WINDOW:
        least = (least & ~_POSITION) | np.arange(len(least), dtype=np.uint64)
        span = 1
        while span < WINDOW:
            step = min(span, WINDOW - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        # windows that lie in one text
        row = w.rows()
        inside = row[: len(least)] == row[WINDOW + KEY - 2 :]
        first[(least[inside] & _POSITION).astype(np.int64)] = True
    at = np.flatnonzero(first)
    return at, np.searchsorted(at, w.bounds)


def _stretches(at: np.ndarray, bounds: np.ndarray, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the stretches, their numbers of words, and their texts: from each chunk on, and up to each chunk's end."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = np.append(at[1:], len(w.starts))
    k = np.minimum(np.searchsorted(ends, at + MIN_WORDS), len(ends) - 1)
    to = ends[k]
    on = at + MIN_WORDS <= w.bounds[1:][doc]
    back = np.maximum(np.searchsorted(at, ends - MIN_WORDS, "right") - 1, 0)
    more = (ends - MIN_WORDS >= w.bounds[:-1][doc]) & (to[back] != ends)
    return np.concatenate([at[on], at[back[more]]]), np.concatenate([(to - at)[on], (ends - at[back])[more]]), np.concatenate([doc[on], doc[more]])


def _digests(h: np.ndarray, at: np.ndarray, n: np.ndarray, base: int) -> np.ndarray:
    """Digest of the words at..at+n: a polynomial over their hashes, and their number."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
    back = powers(pow(base, -1, 2**64), len(h))
    return mix((total[at + n] - total[at]) * back[at] + n.astype(np.uint64)).astype(np.int64)


def chunks(docs: DataFrame, both: bool = True) -> DataFrame:
    """(doc_id, d1[, row, d2, start, words]): stretches of chunks of the texts with an id, by digest; start and words count words.

    ``row`` tells texts of one id apart.
    """

    def run(it):
        for batch in it:
            ids, rows = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", ROW))
            for i, j, w in each(batch.column("text")):
                if not len(w.starts):
                    continue
                h = w.hashes()
                at, n, doc = _stretches(*_chunks(w), w)
                cols = [pa.array(ids[i:j][doc], pa.int64()), pa.array(_digests(h, at, n, _ONE))]
                if both:
                    cols += [pa.array(rows[i:j][doc], pa.int64()), pa.array(_digests(h, at, n, _TWO)), pa.array(at - w.bounds[doc], pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "d1", "row", "d2", "start", "words"][: len(cols)])

    source = text_of(docs, _row().alias(ROW)).where("doc_id is not null")
    return source.mapInArrow(run, "doc_id long, d1 long" + ", row long, d2 long, start long, words long" * both)


def _row():
    return F.xxhash64(F.col("text").cast("string"))


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, words, first): stretches that several documents hold, with the smallest id that does."""
    often = chunks(docs, both=False).groupBy("d1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("d1")
    often = cut(often, "often")  # this table and the next are read back, so that a hot digest's side of a join can be split
    found = cut(chunks(docs).join(often, "d1", "left_semi"), "chunks")
    first = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = cut(first, "first")
    return found.join(first, ["d1", "d2"]).select("doc_id", "row", "start", "words", "first")


def _runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """Runs of overlapping or adjacent stretches of min_words words or more."""
    w = Window.partitionBy("doc_id", "row").orderBy("start", "words")
    upto = lambda end: F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("words")
    runs = repeated.withColumn("new", F.coalesce(upto(end) < F.col("start"), F.lit(True)).cast("long"))
    # words that some smaller id holds too, beyond those of the stretches before
    later = F.when(F.col("first") < F.col("doc_id"), end)
    runs = runs.withColumns({"run": F.sum("new").over(w), "later": F.greatest(later - F.greatest("start", upto(later)), F.lit(0))})
    runs = runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("words")) - F.min("start")).alias("words"), F.min("first").alias("first_doc_id"), F.sum("later").alias("removed_words"))
    return runs.where(F.col("words") >= min_words).select("doc_id", "row", "start", "words", "first_doc_id", "removed_words")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of repeated stretches: doc_id, start, words, first_doc_id, removed_words; start and words count words of the text.

    ``first_doc_id`` is the smallest id that holds a stretch of the run, and
    ``removed_words`` counts the words whose stretch some smaller id holds too.
    Stretches have MIN_WORDS words at least, so a smaller min_words gives no more.
    Repeats within one document don't count, nor do rows without an id or
    text. Rows that share an id are one document; each of its texts has runs of
    its own, and equal rows have them once. Only ``doc_id`` and ``text``
    are read. An empty table gives an empty result.
    """
    return _runs(_repeated(docs), min_words).drop("row")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with all their columns, and without the runs of stretches that documents of smaller id hold.

    What a document is the first to hold stays in it, also next to a run that
    goes; the text around runs stays as it is, byte for byte. Documents stay
    even if their text is then empty. Texts without such a run are not touched.
    """
    runs = _runs(_repeated(docs).where(F.col("first") < F.col("doc_id")), min_words)
    held, spans = "__siftwood_doc__", "__siftwood_runs__"
    runs = runs.groupBy(F.col("doc_id").alias(held), F.col("row").alias(ROW)).agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias(spans))
    wide = docs.join(runs, (docs.doc_id == F.col(held)) & (_row() == F.col(ROW)), "left").drop(held, ROW)
    names = docs.columns

    def run(it):
        for batch in it:
            texts = batch.column("text")
            raw, offsets = buffers(texts)
            spanned = batch.column(spans).to_pylist()
            if any(spanned):
                new = texts.to_pylist()
                for k, runs_of in enumerate(spanned):
                    if runs_of:
                        new[k] = _without(raw[offsets[k] : offsets[k + 1]], runs_of)
                texts = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names)

    return wide.mapInArrow(run, docs.schema)


def _without(raw: np.ndarray, runs: list[dict]) -> str:
    w = words(raw, np.array([0, len(raw)]))
    keep = np.ones(len(raw), bool)
    for r in runs:
        end = r["start"] + r["words"]
        keep[w.starts[r["start"]] : w.starts[end] if end < len(w.starts) else len(raw)] = False
    return raw[keep].tobytes().decode()


__all__ = ["chunks", "remove_repeats", "repeats"]
