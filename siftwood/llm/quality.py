"""Quality rules, and a hashed n-gram log-likelihood ratio for what passes them.

The trusted target is all labelled rows of quality 1, the raw corpus is every
document. Both are multinomials over BUCKETS hashed one- and two-word grams.
A document's score is the mean over its grams of log p_target - log p_raw, and
it is kept from the threshold on, which all labelled rows fix: no draw is made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import WHITE, each, grams, mix, powers, sums
from .shared import cut, text_of
from .totals import dense_totals

BUCKETS = 16384
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(w) -> dict[str, np.ndarray]:
    """The base columns of each text of some Words."""
    n = len(w.bounds) - 1
    doc = w.rows()
    out = {"n_words": w.counts}
    outside = WHITE[w.raw]
    out["word_chars"] = sums(~outside & ((w.raw & 0xC0) != 0x80), w.offsets)
    out["n_symbols"] = sums(SYMBOLS[w.raw], w.offsets)
    coded = w.raw.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) ^ np.uint64(0xD6E8FEB86659FD93)
    base = 0xD1342543DE82EF95
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(coded * powers(base, len(coded)), dtype=np.uint64)])
    back = powers(pow(base, -1, 2**64), len(coded) + 1)
    # lines that hold a word
    new = np.flatnonzero(w.raw == 10)
    begin = np.unique(np.concatenate([w.offsets[:-1], new + 1]))
    begin = begin[begin < len(w.raw)]
    end = np.searchsorted(new, begin)
    stop = np.searchsorted(w.offsets, begin, "right")
    end = np.minimum(np.append(new, len(w.raw))[end], w.offsets[np.minimum(stop, n)])
    held = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[held], end[held]
    of = np.searchsorted(w.offsets, begin, "right") - 1
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    line = mix((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64)) + salt[of]
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(of[again], minlength=n)
    # words in windows of three that come twice
    h = mix((total[w.ends] - total[w.starts]) * back[w.starts] + (w.ends - w.starts).astype(np.uint64)) if len(w.starts) else np.zeros(0, np.uint64)
    g = grams(h, 3)
    inside = np.flatnonzero(doc[: len(g)] == doc[2:]) if len(g) else np.zeros(0, np.int64)
    _, which, times = np.unique(g[inside] + salt[doc[inside]], return_inverse=True, return_counts=True)
    twice = inside[times[which] > 1]
    marked = np.zeros(len(h), bool)
    for k in range(3):
        marked[twice + k] = True
    out["n_repeat_words"] = sums(marked, w.bounds)
    return out


def base_failed(v: dict[str, np.ndarray]) -> np.ndarray:
    return (v["n_words"] < 50) | (100 * v["n_repeat_words"] > 50 * v["n_words"])


def _buckets(w) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one- and two-word grams, and the texts they belong to."""
    h, doc = w.hashes(), w.rows()
    pairs = grams(h, 2)
    inside = doc[1:] == doc[:-1] if len(pairs) else np.zeros(0, bool)
    b = np.concatenate([mix(h), pairs[inside]]) % np.uint64(BUCKETS)
    return b.astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def _count(batch: pa.RecordBatch, total: np.ndarray) -> None:
    for _, _, w in each(batch.column("text")):
        total += np.bincount(_buckets(w)[0], minlength=BUCKETS)


@dataclass
class Ratio:
    """log p_target - log p_raw by bucket."""

    weights: np.ndarray

    def scores(self, w) -> np.ndarray:
        b, doc = _buckets(w)
        n = np.bincount(doc, minlength=len(w.bounds) - 1)
        return np.bincount(doc, self.weights[b], minlength=len(n)) / np.maximum(n, 1)


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(labelled_id, label): one row per labelled id; contradicting labels count as 0."""
    return labels.where(f"doc_id is not null and {column} is not null").groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(F.col(column).cast("int")).alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> Ratio | None:
    """The ratio for docs, counted over all of them and all trusted ones; None if no row is trusted.

    Labels may be as many as documents, so texts and labels meet by shuffle;
    only the labels of a partition are held in memory.
    """
    good = known_labels(labels, "quality").where("label = 1").hint("shuffle_hash")
    trusted = text_of(docs).where("text is not null").join(good, F.col("doc_id") == F.col("labelled_id")).select("text")
    target = dense_totals(trusted, _count, BUCKETS)
    if not target.sum():
        return None
    raw = dense_totals(text_of(docs), _count, BUCKETS)
    return Ratio(np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)))


def least_kept(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold for scored (doc_id, base_failed, llr): cut_between over all labelled rows that pass the base rules."""
    good = known_labels(labels, "quality").hint("shuffle_hash")
    return cut_between(cut(scored.where("not base_failed").join(good, F.col("doc_id") == F.col("labelled_id")).select("label", F.col("llr").alias("score")), "labelled-scores"))


def cut_between(found: DataFrame) -> float:
    """The score that rejects the largest share of label 0 less the share of label 1; in the middle of its gap, the lowest of equals.

    Scores are counted, then sorted in ranges over all tasks. Where a range's best
    cut is does not depend on the rows below it, so one row per range is collected.
    """
    sizes = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(0, 0), sizes.get(1, 0)
    if not n_bad or not n_good:
        return -np.inf

    def best(it):
        parts = [[b.column(c).to_numpy() for c in ("score", "bad", "good")] for b in it if b.num_rows]
        if not parts:
            return
        at, bad, good = map(np.concatenate, zip(*parts, strict=True))
        order = np.argsort(at)
        at, step = at[order], (bad * n_good - good * n_bad)[order]
        # what lies below each score
        gain = np.cumsum(step) - step
        k = int(np.argmax(gain))
        yield pa.RecordBatch.from_pylist([{"first": at[0], "last": at[-1], "all": int(step.sum()), "gain": int(gain[k]), "at": at[k], "before": at[k - 1] if k else None}])

    each_score = found.where("label in (0, 1)").groupBy("score").agg(F.sum(1 - F.col("label")).alias("bad"), F.sum("label").cast("long").alias("good"))
    ranges = each_score.repartitionByRange("score").mapInArrow(best, "first double, last double, all long, gain long, at double, before double").collect()
    threshold, most, below, last = -np.inf, None, 0, None
    for r in sorted(ranges, key=lambda r: r["first"]):
        if most is None or below + r["gain"] > most:
            before = last if r["before"] is None else r["before"]
            most, threshold = below + r["gain"], r["at"] if before is None else (before + r["at"]) / 2
        below, last = below + r["all"], r["last"]
    return threshold


def _scored(docs: DataFrame, model: Ratio | None) -> DataFrame:
    """doc_id, the base columns, base_failed, llr of each row of docs."""

    def run(it):
        for batch in it:
            parts: dict[str, list[np.ndarray]] = {k: [] for k in (*BASE, "llr")}
            for _, _, w in each(batch.column("text")):
                for k, v in base_counts(w).items():
                    parts[k].append(v)
                parts["llr"].append(model.scores(w) if model else np.zeros(len(w.bounds) - 1))
            v = {k: np.concatenate([np.zeros(0, np.int64), *x]) for k, x in parts.items()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v[k].astype(np.int64)) for k in BASE), pa.array(base_failed(v)), pa.array(v["llr"].astype(float))], ["doc_id", *BASE, "base_failed", "llr"])

    return text_of(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, llr double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base columns, base_failed, llr, kept.

    Reads ``doc_id`` and ``text`` only, and of labels ``doc_id`` and
    ``quality``. A null or empty text has no words, fails the base rules and
    has llr 0. Repeated rows give repeated rows. Without a trusted label the
    base rules decide alone. An empty table gives an empty result.
    """
    model = fit(docs, labels)
    out = _scored(docs, model)
    if not model:
        return out.withColumn("kept", ~F.col("base_failed"))
    out = cut(out, "scored")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least_kept(out, labels))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that quality() keeps; no join: rules and ratio run over the rows themselves."""
    model = fit(docs, labels)
    threshold = least_kept(_scored(docs, model).select("doc_id", "base_failed", "llr"), labels) if model else -np.inf

    def run(it):
        for batch in it:
            kept = []
            for _, _, w in each(batch.column("text")):
                kept.append(~base_failed(base_counts(w)) & (model.scores(w) >= threshold if model else True))
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *kept])))

    return docs.mapInArrow(run, docs.schema)
