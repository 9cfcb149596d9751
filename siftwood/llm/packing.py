"""Cost-balanced packing of token ids into sequences of fixed capacity.

Shards of consecutive documents are packed each for itself, inside the task
that reads them: no shuffle, and never more than SHARD tokens in memory. The
sequences of a shard have room for exactly its tokens: as many full ones as
go, and for the rest one for each power of two in it, so nothing is padded.

Documents are taken by descending length. Each goes to the sequence of lowest
cost (linear plus quadratic in its pieces' lengths) that has room; a document
that fits nowhere is cut, and fills up the sequence with the most room first.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import buffers, pieces, words
from .shared import text_of

CAPACITY = 4096
#: Tokens that are packed together.
SHARD = 1 << 22
#: Cost of a piece of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1 / CAPACITY
END = 2
#: Bytes of text that are encoded together: each pass merges its new words into those remembered.
PASS_BYTES = 1 << 20
#: Distinct words that a process remembers the ids of.
MEMORY = 1_000_000

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids by a ``tokenizers`` file whose words don't depend on each other across white space.

    Words between ASCII white space are encoded once and remembered by a 64-bit
    hash of their bytes; the ids of a text are those of its words in order.
    Letters with punctuation behind them are encoded as two parts, since the
    pre-tokenizer parts them as well.
    """

    _parts = re.compile(rb"([A-Za-z\x80-\xff]+)([.,;:!?#$%&*|]+)")

    def __init__(self, path: str):
        # a task has one core; threads of the library's own would each keep memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This process's encoder for ``path``: what a task has learned serves the next one."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _encode_words(self, fresh: list[bytes]) -> list[bytes]:
        """The words' ids, four bytes each."""
        match, keys = self._parts.fullmatch, []
        for x in fresh:
            m = match(x)
            keys.append((m[1].lower(), m[2]) if m and m[1].decode().isalpha() else (x, None))
        parts: dict[bytes, bytes] = {}
        new = list({k for key in keys for k in key if k is not None})
        for a in range(0, len(new), 4_000):
            part = new[a : a + 4_000]
            parts.update(zip(part, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)], strict=True))
        return [parts[a] if b is None else parts[a] + parts[b] for a, b in keys]

    def _learn(self, h: np.ndarray, fresh: list[bytes]) -> None:
        found = self._encode_words(fresh)
        upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        n = int(self.bounds[-1])
        while n + int(upto[-1]) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[n : n + int(upto[-1])] = np.frombuffer(b"".join(found), np.uint32)
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.place = np.insert(self.place, at, np.arange(len(self.bounds) - 1, len(self.bounds) - 1 + len(h)))
        self.bounds = np.concatenate([self.bounds, n + upto])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts, each with END behind, and the texts' bounds in them."""
        w = words(raw, offsets)
        h, first, of = np.unique(w.hashes(exact=True), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[at] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            data = raw.tobytes()
            self._learn(h[new], [data[a:b] for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)])
        at = self.place[np.searchsorted(self.known, h)][of]
        # END is one more word at each text's end
        n = np.insert(self.bounds[at + 1] - self.bounds[at], w.bounds[1:], 1)
        begin = np.insert(self.bounds[at], w.bounds[1:], 0)
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[w.bounds[1:] + np.arange(1, len(offsets))]
        ids[ends - 1] = END
        return ids, np.concatenate([[0], ends])


def capacities(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Room of the sequences for ``total`` tokens: full ones, then the powers of two of the rest."""
    full, rest = divmod(total, capacity)
    return np.array([capacity] * full + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; every sequence is full."""
    room = capacities(int(lengths.sum()), capacity)
    size, cost = room.copy(), np.zeros(len(room))
    out = []

    def put(doc: int, start: int, n: int, k: int) -> None:
        out.append((doc, start, n, k, int(size[k] - room[k])))
        room[k] -= n
        cost[k] += n + quadratic * n * n

    for doc in np.argsort(-lengths, kind="stable"):
        start, left = 0, int(lengths[doc])
        while left:
            fits = room >= left
            if left <= capacity and fits.any():
                put(int(doc), start, left, int(np.argmin(np.where(fits, cost, np.inf))))
                break
            k = int(np.argmax(room))
            n = min(left, int(room[k]))
            put(int(doc), start, n, k)
            start, left = start + n, left - n
    return out


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Reads ``doc_id`` and ``text`` only. A null or empty text is its END id
    alone. Repeated rows are packed each for itself; a row without an id is
    packed with a null doc_id. Sequence ids are unique: the task's number, then
    the sequence's in it. An empty table gives an empty result.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def out(held: list, first: int) -> tuple[pa.RecordBatch, int]:
        ids = np.concatenate([x for _, x, _ in held]).astype("<u4")
        lengths = np.concatenate([n for _, _, n in held])
        doc_ids = pa.concat_arrays([d for d, _, _ in held])
        begin = np.cumsum(lengths) - lengths
        p = np.array(pack(lengths, capacity), np.int64).reshape(-1, 5)
        p = p[np.lexsort((p[:, 4], p[:, 3]))]
        view = memoryview(ids).cast("B")
        at = begin[p[:, 0]] + p[:, 1]
        crc = np.array([zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), p[:, 2].tolist(), strict=True)], np.int64)
        cols = [doc_ids.take(pa.array(p[:, 0])), p[:, 1], p[:, 2], crc, lengths[p[:, 0]], p[:, 3] + first, p[:, 4]]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in cols], names), first + int(p[:, 3].max(initial=-1)) + 1

    def run(it: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encoder, held, total, first = Encoder.of(tokenizer), [], 0, TaskContext.get().partitionId() << 36
        for batch in it:
            raw, offsets = buffers(batch.column("text"))
            for i, j in pieces(offsets, PASS_BYTES):
                at = offsets[i : j + 1]
                ids, bounds = encoder.encode(raw[at[0] : at[-1]], at - at[0])
                held.append((batch.column("doc_id").slice(i, j - i), ids.astype(np.uint16) if ids.max(initial=0) < 65536 else ids, np.diff(bounds)))
                total += len(ids)
                if total >= shard:
                    rows, first = out(held, first)
                    yield rows
                    held, total = [], 0
        if held:
            yield out(held, first)[0]

    return text_of(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def cost(pieces_of: DataFrame, quadratic: float = QUADRATIC) -> DataFrame:
    """Cost and filling of each sequence: sequence_id, pieces, tokens, cost."""
    n = F.col("length").cast("double")
    return pieces_of.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("tokens"), F.sum(n + quadratic * n * n).alias("cost"))
