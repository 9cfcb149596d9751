"""Language-model scoring: a log-bilinear model over word classes, trained with noise-contrastive estimation.

Vocabulary: the CORE most frequent training words are classes of their own, and
so is a text's end; every other word is in one of RARE classes by its last two
bytes. The probability of a token is that of its class after the two classes
before it, times the token's share in its class by smoothed counts; the words
that training never met share one more place in each class. So the probabilities
sum to one.

Counts are taken over all training texts. A token's count comes back to the
texts through blocks: a block of documents is joined with the distinct words it
holds, not with every one of its tokens.

Training: each task runs minibatches over one of ``rounds`` parts of
its texts (another one in every round) from common parameters, and the tasks'
parameters are averaged by the number of tokens seen; so each training text is
trained on once. Scoring: for the distinct contexts of a
block, a matrix product gives all classes' scores, and their log-sum normalises.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import Words, buffers, each
from .shared import cut, text_of
from .totals import dense_totals

#: Words that are classes of their own.
CORE = 2048
RARE = 48
DIM = 24
NOISE = 64
BATCH = 1024
RATE = 0.25
ROUNDS = 3
#: A block ends after so many bytes of text of a task's input, and after so many rows of tiny ones.
BLOCK_BITS, BLOCK_BYTES = 16, 1 << 24
#: Contexts whose scores of all classes are made at once: what a processor's cache holds.
CONTEXTS = 384
END_HASH = np.uint64(0x9AE16A3B2F90404F)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(10)) == 0


def rare_class(w: Words) -> np.ndarray:
    """0..RARE-1 by the word's last two bytes."""
    last = w.low[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.low[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
    return (last * 257 + before * 31 + (before >> 3)) % RARE


@dataclass
class Model:
    """Parameters. Classes: CORE words, RARE classes, the end; one more context stands before a text."""

    core: np.ndarray  # sorted hashes
    core_place: np.ndarray
    tokens: int
    types: int
    docs: int
    rare_tokens: np.ndarray
    rare_types: np.ndarray
    noise: np.ndarray  # log-probabilities of the classes
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def classes(self) -> int:
        return len(self.core) + RARE + 1

    def class_of(self, h: np.ndarray, rare: np.ndarray) -> np.ndarray:
        if not len(self.core):
            return rare + len(self.core)
        at = np.minimum(np.searchsorted(self.core, h), len(self.core) - 1)
        return np.where(self.core[at] == h, self.core_place[at], rare + len(self.core))

    def sequence(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all tokens with ends, the two before each, and the texts' bounds."""
        c = self.class_of(h, rare_class(w))
        n = len(w.bounds) - 1
        full = np.insert(c, w.bounds[1:], self.classes - 1)
        bounds = w.bounds + np.arange(n + 1)
        begin = self.classes  # the context before a text
        one, two = np.full(len(full), begin), np.full(len(full), begin)
        one[1:], two[2:] = full[:-1], full[:-2]
        one[bounds[:-1]] = begin
        two[bounds[:-1]] = begin
        second = bounds[:-1] + 1
        two[second[second < bounds[1:]]] = begin
        return full, one, two, bounds

    def start(self) -> None:
        r = np.random.Generator(np.random.PCG64(7))
        v = self.classes
        self.params = {"a1": r.normal(0, 0.1, (v + 1, DIM)), "a2": r.normal(0, 0.1, (v + 1, DIM)), "q": r.normal(0, 0.1, (v, DIM)), "b": self.noise.copy()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.params[k].ravel() for k in ("a1", "a2", "q", "b")])

    def unflat(self, x: np.ndarray) -> None:
        at = 0
        for k in ("a1", "a2", "q", "b"):
            n = self.params[k].size
            self.params[k] = x[at : at + n].reshape(self.params[k].shape)
            at += n

    def log_probabilities(self, full: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log-probability of each class after its context, normalised over all classes."""
        a1, a2, q, b = (self.params[k].astype(np.float32) for k in ("a1", "a2", "q", "b"))
        q = np.ascontiguousarray(q.T)
        pair = one.astype(np.int64) * (self.classes + 1) + two
        distinct, which = np.unique(pair, return_inverse=True)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        out = np.empty(len(full))
        for i in range(0, len(distinct), CONTEXTS):
            d = distinct[i : i + CONTEXTS]
            r = a1[d // (self.classes + 1)] + a2[d % (self.classes + 1)]
            s = r @ q
            s += b
            top = s.max(1)
            s -= top[:, None]
            mine = order[bounds[i] : bounds[i + len(d)]]
            row = which[mine] - i
            out[mine] = s[row, full[mine]]
            z = np.log(np.exp(s, out=s).sum(1))
            out[mine] -= z[row]
        return out


class Trainer:
    """Minibatch noise-contrastive estimation with AdaGrad; each batch shares its noise words."""

    def __init__(self, model: Model, seed: int):
        self.m = model
        self.p = {k: v.astype(np.float32) for k, v in model.params.items()}
        self.g = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}
        self.r = np.random.Generator(np.random.PCG64(seed))
        self.upto = np.cumsum(np.exp(model.noise))
        self.base = model.noise.astype(np.float32)
        self.seen = 0

    def _step(self, k: str, rows, grad: np.ndarray) -> None:
        self.g[k][rows] += grad * grad
        self.p[k][rows] += RATE * grad / np.sqrt(self.g[k][rows])

    def _sum(self, rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # 16-bit keys are sorted by radix
        order = np.argsort(rows.astype(np.uint16) if self.m.classes < 65535 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        return rows[first], np.add.reduceat(grad[order], first, axis=0)

    def run(self, full: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.r.permutation(len(full))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            w, c1, c2 = full[pick], one[pick], two[pick]
            noise = np.minimum(np.searchsorted(self.upto, self.r.random(NOISE) * self.upto[-1]), len(self.upto) - 1)
            p, n = self.p, len(pick)
            r = p["a1"][c1] + p["a2"][c2]
            ratio = np.float32(np.log(NOISE))
            good = (r * p["q"][w]).sum(1) + p["b"][w] - self.base[w] - ratio
            bad = r @ p["q"][noise].T + (p["b"][noise] - self.base[noise] - ratio)
            up = 1 / (1 + np.exp(np.clip(good, -30, 30)))
            down = -1 / (1 + np.exp(-np.clip(bad, -30, 30)))
            dr = up[:, None] * p["q"][w] + down @ p["q"][noise]
            rows = np.concatenate([w, noise])
            dq = np.concatenate([up[:, None] * r, down.T @ r])
            db = np.concatenate([up, down.sum(0)])
            q, dq = self._sum(rows, np.concatenate([dq, db[:, None]], 1))
            scale = np.float32(1 / n)
            self._step("q", q, dq[:, :-1] * scale)
            self._step("b", q, dq[:, -1] * scale)
            for k, c in (("a1", c1), ("a2", c2)):
                own, d = self._sum(c, dr)
                self._step(k, own, d * scale)
            self.seen += n

    def params(self) -> np.ndarray:
        return np.concatenate([self.p[k].astype(np.float64).ravel() for k in ("a1", "a2", "q", "b")])


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, block), written to the shared folder: a block is at most 2**BLOCK_BITS rows of one task's input, and BLOCK_BYTES of text and one text more."""

    def run(it):
        from pyspark import TaskContext

        base, rows, size = TaskContext.get().partitionId() << 40, 0, 0
        for batch in it:
            ends = size + np.cumsum(np.diff(buffers(batch.column("text"))[1]))
            before = np.concatenate([[size], ends[:-1]])
            # both parts only ever rise, so their sum tells the pairs of them apart
            block = base + before // BLOCK_BYTES + (rows + np.arange(batch.num_rows) >> BLOCK_BITS)
            rows, size = rows + batch.num_rows, int(ends[-1]) if batch.num_rows else size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], ["doc_id", "text", "held_out", "block"])

    rows = text_of(docs, F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return cut(rows.mapInArrow(run, "doc_id long, text string, held_out boolean, block long"), "blocks")


def _words_by_block(rows: DataFrame) -> DataFrame:
    """(block, hash, rare, n): the distinct words of each block, and how often training texts there hold them."""

    def run(it):
        for batch in it:
            block = batch.column("block").to_numpy()
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            for k in np.unique(block):
                mine = np.flatnonzero(block == k)
                hs, rs, ns = [], [], []
                for i, j, w in each(batch.column("text").slice(mine[0], len(mine))):
                    h, first, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
                    n = np.bincount(of[train[mine[0] + i : mine[0] + j][w.rows()]], minlength=len(h))
                    hs.append(h)
                    rs.append(rare_class(w)[first])
                    ns.append(n)
                h = np.concatenate([np.zeros(0, np.uint64), *hs])
                h, first, of = np.unique(h, return_index=True, return_inverse=True)
                n = np.bincount(of, np.concatenate([np.zeros(0), *ns]), len(h)).astype(np.int64)
                rare = np.concatenate([np.zeros(0, np.int64), *rs])[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h.view(np.int64)), pa.array(rare.astype(np.int32)), pa.array(n)], ["block", "hash", "rare", "n"])

    return rows.mapInArrow(run, "block long, hash long, rare int, n long")


def fit(rows: DataFrame, counts: DataFrame, core: int = CORE, rounds: int = ROUNDS) -> Model:
    """The model of blocks() and the counts (hash, rare, c) of their training words. The driver gets fixed-size vectors only."""
    top = counts.orderBy(F.desc("c"), "hash").limit(core).collect()
    by_hash = sorted((np.uint64(r["hash"] & (2**64 - 1)), k, r["c"]) for k, r in enumerate(top))
    hashes = np.array([x[0] for x in by_hash], np.uint64)
    place = np.array([x[1] for x in by_hash], np.int64)
    docs = rows.where("not held_out").count()
    by_class = {r["rare"]: (r["types"], r["tokens"]) for r in counts.groupBy("rare").agg(F.count("*").alias("types"), F.sum("c").alias("tokens")).collect()}
    types, tokens = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
    for k, (a, b) in by_class.items():
        types[k], tokens[k] = a, b
    all_types, all_tokens = int(types.sum()) + (docs > 0), int(tokens.sum()) + docs
    for r in top:
        types[r["rare"]] -= 1
        tokens[r["rare"]] -= r["c"]
    n = np.concatenate([np.array([r["c"] for r in top], float), tokens + 0.1 * (types + 1), [docs + 0.1]])
    model = Model(hashes, place, all_tokens, all_types, docs, tokens, types, np.log(n / n.sum()))
    model.start()
    for turn in range(rounds if docs else 0):
        width = model.flat().size

        def begin(turn: int = turn):
            from pyspark import TaskContext

            local = Trainer(model, TaskContext.get().partitionId() * rounds + turn)

            def step(batch: pa.RecordBatch, _: np.ndarray) -> None:
                train = np.flatnonzero(~batch.column("held_out").to_numpy(zero_copy_only=False))
                for _, _, w in each(batch.column("text").take(pa.array(train[turn::rounds]))):
                    full, one, two, _ = model.sequence(w, w.hashes())
                    local.run(full, one, two)

            def end(total: np.ndarray) -> None:
                total[:-1] = local.params() * local.seen
                total[-1] = local.seen

            return step, end

        total = dense_totals(rows.select("text", "held_out"), None, width + 1, np.float64, begin)
        if total[-1]:
            model.unflat(total[:-1] / total[-1])
    return model


def score(docs: DataFrame, core: int = CORE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Reads ``doc_id`` and ``text`` only. A null or empty text is its end alone.
    Repeated rows give repeated rows; a row without an id is not held out.
    Without training texts every class is as likely. An empty table gives an
    empty result.
    """
    rows = blocks(docs)
    words = cut(_words_by_block(rows), "words")
    counts = cut(words.groupBy("hash").agg(F.min("rare").alias("rare"), F.sum("n").alias("c")).where("c > 0"), "counts")
    model = fit(rows, counts, core, rounds)
    held = words.select("block", "hash").join(counts.select("hash", "c"), "hash").select("block", "hash", "c")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(known, kind="stable")
        known, c = known[order], right.column("c").to_numpy()[order]
        sums = lambda v, b: np.diff(np.concatenate([[0.0], np.cumsum(v)])[b])
        whole = model.tokens + 0.1 * (model.types + 1)
        end = np.log10((model.docs + 0.1) / whole)
        parts: list[list[np.ndarray]] = [[], [], [], []]
        tokens: list[tuple[np.ndarray, ...]] = []
        for _, _, w in each(left.column("text").combine_chunks()):
            h = w.hashes()
            full, one, two, bounds = model.sequence(w, h)
            tokens.append((full.astype(np.int32), one.astype(np.int32), two.astype(np.int32), np.diff(bounds)))
            n = np.zeros(len(h), np.int64)
            if len(known) and len(h):
                distinct, of = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                n = np.where(known[at] == distinct, c[at], 0)[of]
            rare = full[full < model.classes - 1].astype(np.int64) - len(model.core)
            share = np.zeros(len(h))
            r = rare >= 0
            share[r] = np.log10((n[r] + 0.1) / (model.rare_tokens[rare[r]] + 0.1 * (model.rare_types[rare[r]] + 1)))
            parts[0].append(w.counts + 1)
            parts[1].append(sums(n > 0, w.bounds).astype(np.int64) + (model.docs > 0))
            parts[2].append(sums(np.log10((n + 0.1) / whole), w.bounds) + end)
            parts[3].append(sums(share, w.bounds))
        v = [np.concatenate(x) if x else np.zeros(0) for x in parts]
        if tokens:  # contexts of the whole block are normalised once
            full, one, two, length = (np.concatenate(x) for x in zip(*tokens, strict=True))
            v[3] = v[3] + sums(model.log_probabilities(full, one, two) / np.log(10), np.concatenate([[0], np.cumsum(length)]))
        cols = [left.column("doc_id").combine_chunks(), left.column("held_out").combine_chunks(), pa.array(v[0].astype(np.int64)), pa.array(v[1].astype(np.int64)), pa.array(np.full(left.num_rows, model.tokens)), pa.array(v[2]), pa.array(v[3])]
        return pa.Table.from_arrays(cols, names)

    return rows.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


__all__ = ["Model", "Trainer", "blocks", "fit", "score"]
