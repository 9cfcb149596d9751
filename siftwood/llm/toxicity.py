"""Toxicity by compression distance: one zstandard dictionary for toxic text, one for ordinary text.

A text is written as three bytes for each of its own, the byte itself and two
hashes of it with its neighbours in its word, so that chance matches of
syllables are rare and short words weigh more than a match costs. Its windows
are WINDOW words each. A window's distance is the length that it compresses to
with the ordinary dictionary less the length with the toxic one; how many of a
text's windows reach each distance in REACH is calibrated into its score. All
windows are compressed with both dictionaries by a fast search first; those that
the toxic one shortens by NEAR bytes are compressed again by a thorough one.

Training takes the labelled texts in two halves. On one, zstandard trains the
ordinary dictionary from windows of ordinary text, and the toxic one from
windows of toxic text. Most words of a toxic text are ordinary, so both are
trained again in a few rounds: toxic windows count that a dictionary of *other*
toxic texts shortens (texts are dealt to two folds, each judged by the other's
dictionary), and ordinary windows that it shortens as well are learned by the
ordinary dictionary. The toxic dictionary is used in front of the ordinary one,
so that both find the same ordinary matches. The other half of the texts
calibrates the distances. No word is counted or listed.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import WHITE, each, sums
from .quality import known_labels
from .shared import cut, text_of

#: Labelled rows of each class that the model is fitted on, at most; the first by a hash of the id.
SAMPLE = 4_000
#: Distinct windows of each class that the dictionaries are trained on, at most; the first by a hash. Longer ones than LONGEST bytes are not trained on.
WINDOWS = 200_000
LONGEST = 4_096
WINDOW = 4
#: Bytes of the dictionaries.
ORDINARY, TOXIC = 1 << 18, 6_144
#: Bytes of a segment that the trainer picks, in coded text.
SEGMENT, LONG_SEGMENT = 24, 96
ROUNDS = 4
#: A window counts as toxic in training from this distance on.
APART = 8
#: Distance by the fast search from which on the thorough one is made.
NEAR = 4
LEVEL = 16
REACH = np.array([3, 4, 5, 6, 7, 8, 10, 12, 15])
THRESHOLD = 0.3


def held_out(doc_id: str = "doc_id", of: int = 4, rest: int = 2):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of)) == rest


def coded(w) -> tuple[bytes, np.ndarray]:
    """Three bytes for each byte of some Words without white space, and the words' bounds in them."""
    now = w.low.astype(np.uint32)
    back, ahead = np.full_like(now, 32), np.full_like(now, 32)
    back[1:], ahead[:-1] = now[:-1], now[1:]
    back[w.starts], ahead[w.ends - 1] = 32, 32
    mixed = (back << np.uint32(16) | now << np.uint32(8) | ahead) * np.uint32(0x85EBCA6B)
    three = np.stack([w.low, mixed >> np.uint32(16) & np.uint32(255), mixed >> np.uint32(24)], 1).astype(np.uint8)
    return three[~WHITE[w.low]].tobytes(), 3 * np.concatenate([[0], np.cumsum(w.ends - w.starts)])


def windows(w, size: int = WINDOW) -> tuple[list[bytes], np.ndarray]:
    """The coded windows of some Words, ``size`` words each (a text's last one may have fewer), and each text's range of windows."""
    data, at = coded(w)
    per_text = -(-w.counts // size)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    first = np.repeat(w.bounds[:-1], per_text) + size * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], per_text))
    last = np.minimum(first + size, np.repeat(w.bounds[1:], per_text))
    return [data[a:b] for a, b in zip(at[first].tolist(), at[last].tolist(), strict=True)], bounds


def _trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary of at most ``size`` bytes by zstandard's trainer; samples that are few or fit whole are the dictionary."""
    import zstandard as z

    if sum(map(len, samples)) <= size or len(samples) < 64:
        return b"".join(samples)[:size]
    return z.train_dictionary(size, samples, k=segment, d=8).as_bytes()


class Compressor:
    """Compressed lengths with a dictionary, by a fast search and by a thorough one."""

    def __init__(self, content: bytes):
        import zstandard as z

        def made(**how):
            held = z.ZstdCompressionDict(content or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            p = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, window_log=20, min_match=3, format=z.FORMAT_ZSTD1_MAGICLESS, **how)
            held.precompute_compress(compression_params=p)
            return z.ZstdCompressor(dict_data=held, compression_params=p).compress

        self.fast, self.thorough = made(strategy=z.STRATEGY_DFAST, chain_log=19, hash_log=19), made()


def _lengths(compress, said: list[bytes]) -> np.ndarray:
    return np.fromiter((len(compress(x)) for x in said), np.int32, len(said))


def _distances(ordinary: Compressor, toxic: Compressor, said: list[bytes]) -> np.ndarray:
    """How much shorter the toxic dictionary makes each coded window; 0 where the fast search finds less than NEAR."""
    out = _lengths(ordinary.fast, said) - _lengths(toxic.fast, said)
    near = np.flatnonzero(out >= NEAR)
    out[out < NEAR] = 0
    some = [said[k] for k in near]
    out[near] = _lengths(ordinary.thorough, some) - _lengths(toxic.thorough, some)
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 + 3 * len(REACH)))

    def ready(self) -> Model:
        self._ordinary, self._toxic = Compressor(self.ordinary), Compressor(self.ordinary + self.toxic)
        return self

    def distances(self, said: list[bytes]) -> np.ndarray:
        return _distances(self._ordinary, self._toxic, said)

    def features(self, w) -> np.ndarray:
        """Per text: log of windows, and for each distance in REACH the log of the windows that reach it, and whether one or two do."""
        said, bounds = windows(w)
        d = self.distances(said)
        out = [np.log1p(np.diff(bounds))]
        for k in REACH:
            c = sums(d >= k, bounds)
            out += [np.log1p(c), (c >= 1) * 1.0, (c >= 2) * 1.0]
        return np.stack(out, 1)

    def scores(self, w) -> np.ndarray:
        return _sigmoid(self.features(w) @ self.weights[1:] + self.weights[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) * w)
        w += np.clip(step, -5, 5)
    return w


def train(toxic: list[list[bytes]], ordinary: list[bytes]) -> Model:
    """Dictionaries out of distinct windows: of toxic texts, in two folds of texts, and of ordinary ones."""
    base = _trained(ORDINARY, ordinary, LONG_SEGMENT)
    picked = toxic
    for turn in range(ROUNDS):
        size, segment = (ORDINARY, LONG_SEGMENT) if turn == 0 else (TOXIC, SEGMENT)
        plain = Compressor(base)
        tried = [Compressor(base + _trained(size, p, segment)) for p in picked]
        picked = [[x for x, d in zip(toxic[k], _distances(plain, tried[1 - k], toxic[k]), strict=True) if d >= APART] for k in (0, 1)]
        shorter = np.maximum(_distances(plain, tried[0], ordinary), _distances(plain, tried[1], ordinary))
        base += _trained(ORDINARY, [x for x, d in zip(ordinary, shorter, strict=True) if d >= APART], SEGMENT)
    return Model(base, _trained(TOXIC, picked[0] + picked[1], SEGMENT))


def _distinct_windows(known: DataFrame, most: int) -> DataFrame:
    """(label, fold, window): distinct windows of the labelled texts; those that ordinary texts hold are ordinary. At most ``most`` of each class."""

    def run(it):
        for batch in it:
            label, fold = (batch.column(c).to_numpy() for c in ("label", "fold"))
            for i, j, w in each(batch.column("text")):
                said, bounds = windows(w)
                of = np.repeat(np.arange(i, j), np.diff(bounds))
                fit = np.fromiter((len(x) <= LONGEST for x in said), bool, len(said))
                yield pa.RecordBatch.from_arrays([pa.array(label[of]), pa.array(fold[of]), pa.array(said, pa.binary())], ["label", "fold", "window"]).filter(pa.array(fit))

    said = known.select("text", "label", "fold").mapInArrow(run, "label int, fold int, window binary")
    once = said.groupBy("window").agg(F.min(F.struct("label", "fold")).alias("of")).select("of.label", "of.fold", "window").withColumn("place", F.xxhash64("window"))
    parts = [once.where(F.col("label") == k).orderBy("place", "window").limit(most) for k in (0, 1)]
    return cut(parts[0].unionByName(parts[1]), "windows", 1)


def labelled(docs: DataFrame, labels: DataFrame, column: str, most: int, where: Column) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents of each class, the first by a hash of the id.

    Contradicting labels of one id count as 0. The ids that are sent to all
    executors are at most twice ``most``, whatever the input's size.
    """
    known = known_labels(labels, column)
    picked = None
    for k in (0, 1):
        part = known.where(F.col("label") == k).where(where).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    picked = cut(picked, "picked")
    return cut(text_of(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id")).select("labelled_id", "text", "label"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> Model:
    """The model of the labelled rows that are not held out.

    ``sample`` bounds the labelled rows of a class and ``most`` the distinct
    windows of a class; one task trains the dictionaries on these windows. The
    driver gets the dictionaries (at most a few MB) and the features of the
    calibrating rows (at most ``sample`` of a class).
    """
    known = labelled(docs, labels, "toxic", sample, ~held_out("labelled_id"))
    place = F.pmod(F.xxhash64("labelled_id", F.lit(7)), F.lit(4))
    known = known.withColumn("fold", place.cast("int"))
    taught = _distinct_windows(known.where("fold < 2"), most)

    def teach(it):
        toxic, ordinary = [[], []], []
        for batch in it:
            for label, fold, window in zip(*(batch.column(c).to_pylist() for c in ("label", "fold", "window")), strict=True):
                (toxic[fold] if label else ordinary).append(window)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(toxic, ordinary))], pa.binary())], ["model"])

    row = taught.select("label", "fold", "window", "place").coalesce(1).sortWithinPartitions("place", "window").mapInArrow(teach, "model binary").first()
    model = pickle.loads(row[0]) if row else Model(b"", b"")

    def measure(it):
        model.ready()
        for batch in it:
            x = np.concatenate([np.zeros((0, len(model.weights) - 1)), *(model.features(w) for _, _, w in each(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("labelled_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["labelled_id", "label", "x"])

    rows = sorted(known.where("fold >= 2").select("labelled_id", "label", "text").mapInArrow(measure, "labelled_id long, label int, x array<double>").collect())
    y = np.array([r["label"] for r in rows], float)
    if len(np.unique(y)) == 2:
        model.weights = _fit_weights(np.array([r["x"] for r in rows]), y)
    else:
        share = known.agg(F.sum("label"), F.count("*")).first()
        toxic, n = share[0] or 0, share[1]
        model.weights[0] = np.log((toxic + 0.5) / (n - toxic + 0.5))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from the threshold on).

    Reads ``doc_id`` and ``text``, of labels ``doc_id`` and ``toxic``. Null and
    empty texts are scored as texts without windows. Without calibrating rows of
    both classes every score is the labelled share. Repeated rows give
    repeated rows; a row without an id is not held out. An empty table gives an
    empty result.
    """
    model = fit(docs, labels, sample)

    def run(it):
        model.ready()
        for batch in it:
            score = np.concatenate([np.zeros(0), *(model.scores(w) for _, _, w in each(batch.column("text")))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return text_of(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
