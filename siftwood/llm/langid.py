"""Language identification: scripts, then Viterbi over per-word scores.

Learned from labelled texts, as counts over all of them: hashed byte trigrams
(with the word's bounds) by language, and letters of each script by language.
A word's candidates are the languages that use its scripts; its score for each
is the sum of log-probabilities of its trigrams. Viterbi with a penalty for
each switch labels the words, so that a text may hold spans of several
languages; the text's label is that of most letters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import buffers, pieces, sums, words
from .shared import text_of
from .totals import dense_totals

BUCKETS = 1 << 15
#: What a switch of language costs, in natural log units.
PENALTY = 12.0
#: A language uses a script if so large a share of its letters is of it.
SHARE = 0.001
#: First code points of script ranges: fixed values from the Unicode block list; the last of each pair is its script.
SCRIPTS = (
    (0x0000, 0), (0x0250, 0), (0x0370, 1), (0x0400, 2), (0x0530, 3), (0x0590, 4), (0x0600, 5), (0x0700, 15), (0x0900, 6), (0x0980, 7),
    (0x0A00, 8), (0x0B80, 9), (0x0C00, 15), (0x0E00, 10), (0x0E80, 15), (0x10A0, 11), (0x1100, 12), (0x1200, 15), (0x1E00, 0), (0x1F00, 1),
    (0x2000, 15), (0x3040, 13), (0x3100, 15), (0x3400, 14), (0xA000, 15), (0xAC00, 12), (0xD7B0, 15), (0xF900, 14), (0xFB00, 15), (0x20000, 14),
)
OTHER = 15
N_SCRIPTS = 16
_starts = np.array([a for a, _ in SCRIPTS])
_script = np.array([s for _, s in SCRIPTS])


def _letters() -> np.ndarray:
    """Code points that are letters, by Python's table."""
    global _is_letter
    if _is_letter is None:
        # the planes above hold no letters
        _is_letter = np.fromiter((chr(i).isalpha() for i in range(0x34000)), bool, 0x34000)
    return _is_letter


_is_letter: np.ndarray | None = None


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the characters' first bytes in valid UTF-8, and the code points."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = np.concatenate([raw, np.zeros(4, np.uint8)])
    c = b[at].astype(np.int32)
    for lead, bits, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        k = np.flatnonzero(c >= lead) if n == 1 else np.flatnonzero(b[at] >= lead)
        v = b[at[k]].astype(np.int32) & bits
        for j in range(1, n + 1):
            v = v << 6 | (b[at[k] + j].astype(np.int32) & 0x3F)
        c[k] = v
    return at, c


class Text:
    """What some texts show: words with their letters by script, and hashed trigrams."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.w = w = words(raw, offsets)
        table = _letters()
        at, c = code_points(raw)
        letter = np.zeros(len(raw), bool)
        script = np.full(len(raw), OTHER, np.uint8)
        is_letter = (c < len(table)) & table[np.minimum(c, len(table) - 1)]
        letter[at] = is_letter
        odd = is_letter & (c >= 0x250)
        script[at[is_letter]] = 0
        script[at[odd]] = _script[np.searchsorted(_starts, c[odd], "right") - 1]
        self.letter, self.script, self.odd = letter, script, bool(odd.any())
        bounds = np.append(w.starts, len(raw))
        self.letters = sums(letter, bounds)  # by word: between words there is white space only
        self.doc = w.rows()

    def trigrams(self) -> np.ndarray:
        """A bucket for each byte of a word: the byte and the two before it, a zero standing for what is outside the word."""
        low = self.w.low.astype(np.uint32)
        back1, back2 = np.zeros_like(low), np.zeros_like(low)
        back1[1:], back2[2:] = low[:-1], low[:-2]
        back1[self.w.starts] = 0
        back2[self.w.starts] = 0
        second = self.w.starts + 1
        back2[second[second < len(low)]] = 0
        x = (low | back1 << np.uint32(8) | back2 << np.uint32(16)) * np.uint32(0x9E3779B1)
        return x >> np.uint32(17)

    def inside(self) -> np.ndarray:
        """Bytes that are in a word with a letter."""
        edge = np.zeros(len(self.w.raw) + 1, np.int8)
        has = self.letters > 0
        edge[self.w.starts[has]] += 1
        edge[self.w.ends[has]] -= 1
        return np.cumsum(edge[:-1]).astype(bool)


def texts(column: pa.Array):
    raw, offsets = buffers(column)
    for i, j in pieces(offsets, 1 << 22):
        at = offsets[i : j + 1]
        yield i, j, Text(raw[at[0] : at[-1]], at - at[0])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray
    uses: np.ndarray
    penalty: float = PENALTY

    def word_scores(self, t: Text) -> np.ndarray:
        """For each word and language, the sum of log-probabilities; far lower where the language does not use the word's scripts."""
        inside = t.inside()
        tri = t.trigrams()
        bounds = np.append(t.w.starts, len(t.w.raw))
        out = np.empty((len(t.w.starts), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            v = np.where(inside, self.weights[k][tri], 0)
            total = np.concatenate([np.zeros(1), np.cumsum(v, dtype=np.float64)])
            out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
        if t.odd or not self.uses[:, 0].all():
            for s in range(N_SCRIPTS - 1):
                if (has := sums(t.letter & (t.script == s), bounds) > 0).any() and self.uses[:, s].any():
                    out[np.ix_(has, ~self.uses[:, s])] -= 50.0
        return out

    def label(self, t: Text) -> np.ndarray:
        """Viterbi labels of the words: texts are taken side by side, the longest first, a word of each at a time."""
        score = self.word_scores(t)
        n_lang = score.shape[1]
        if not n_lang:
            return np.zeros(len(score), np.int16)
        counts = t.w.counts
        order = np.argsort(-counts, kind="stable")
        start, left = t.w.bounds[:-1][order], counts[order]
        best = np.zeros((len(order), n_lang), np.float64)
        stayed = np.zeros(score.shape, bool)
        top = np.zeros(len(score), np.int16)
        longest = int(left[0]) if len(left) else 0
        live = np.searchsorted(-left, -np.arange(longest), "left")  # texts with more than so many words
        rows = np.arange(len(order))
        for k in range(longest):
            m = live[k]
            at, b = start[:m] + k, best[:m]
            if k:
                lead = b.argmax(1)
                jump = b[rows[:m], lead] - self.penalty
                top[at] = lead
                stay = b >= jump[:, None]
                stayed[at] = stay
                b = np.where(stay, b, jump[:, None])
            best[:m] = b + score[at]
        out = np.zeros(len(score), np.int16)
        now = best.argmax(1)
        for k in range(longest - 1, -1, -1):
            m = live[k]
            at = start[:m] + k
            out[at] = now[:m]
            if k:
                now[:m] = np.where(stayed[at, now[:m]], now[:m], top[at])
        return out

    def documents(self, t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's language number (-1 without letters), its share of the letters, and all words' labels."""
        n = len(t.w.bounds) - 1
        labels = self.label(t)
        held = np.zeros((n, max(len(self.langs), 1)))
        np.add.at(held, (t.doc, labels), t.letters)
        total = held.sum(1)
        best = held.argmax(1)
        return np.where((total > 0) & (len(self.langs) > 0), best, -1), held[np.arange(n), best] / np.maximum(total, 1), labels


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~F.coalesce(held_out(), F.lit(False)))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1


def fit(docs: DataFrame, penalty: float = PENALTY) -> Model:
    """The model of the rows that are not held out. The driver gets one vector of fixed width for each language."""
    rows = _train_rows(docs)
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    place = {x: k for k, x in enumerate(langs)}
    width = BUCKETS + N_SCRIPTS

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        table = total.reshape(len(langs), width)
        of = np.array([place[x] for x in batch.column("lang").to_pylist()])
        for i, j, t in texts(batch.column("text")):
            inside, lang = t.inside(), of[i:j]
            doc = np.repeat(np.arange(j - i), np.diff(t.w.offsets))
            tri = t.trigrams()
            for k in np.unique(lang):
                mine = lang[doc] == k
                table[k, :BUCKETS] += np.bincount(tri[mine & inside], minlength=BUCKETS)
                table[k, BUCKETS:] += np.bincount(t.script[mine & t.letter], minlength=N_SCRIPTS)

    if not langs:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, N_SCRIPTS), bool), penalty)
    table = dense_totals(rows.select("text", "lang"), count, len(langs) * width).reshape(len(langs), width)
    tri, letters = table[:, :BUCKETS], table[:, BUCKETS:]
    weights = np.log((tri + 0.5) / (tri.sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, weights, letters >= SHARE * np.maximum(letters.sum(1, keepdims=True), 1), penalty)


def languages(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, spans.

    ``spans`` are the text's runs of one language, as (start, words, lang) in
    words; ``score`` is the share of letters in ``lang_pred``'s spans. A null
    text, one without a letter, and every text if no row has a language, is
    ``und`` with score 0. Reads ``doc_id``, ``text``, ``lang`` only; repeated
    rows give repeated rows, a row without an id is not held out. An empty
    table gives an empty result.
    """
    model = fit(docs, penalty)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))

    def run(it):
        names = np.array([*model.langs, "und"], object)
        for batch in it:
            pred, score, spans = [np.zeros(0, object)], [np.zeros(0)], []
            for i, j, t in texts(batch.column("text")):
                best, share, labels = model.documents(t)
                pred.append(names[best])
                score.append(np.where(best >= 0, share, 0.0))
                new = np.ones(len(labels), bool)
                new[1:] = (labels[1:] != labels[:-1]) | (t.doc[1:] != t.doc[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(labels)))
                bounds = np.searchsorted(at, t.w.bounds)
                flat = pa.StructArray.from_arrays([pa.array(at - t.w.bounds[t.doc[at]], pa.int64()), pa.array(n, pa.int64()), pa.array(names[labels[at]] if model.langs else ["und"] * len(at), pa.string())], ["start", "words", "lang"])
                spans.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.concatenate(pred), pa.string()), pa.array(np.concatenate(score)), pa.concat_arrays(spans) if spans else pa.array([], spans_type)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return text_of(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<start: long, words: long, lang: string>>")
