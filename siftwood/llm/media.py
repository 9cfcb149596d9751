"""Media columns: payloads as lossless 8-bit images in archives, and a data source that reads them by byte range.

An archive is a ZIP file of stored members. Writing tasks write one archive
each; a manifest made at the commit names those that count, so what a lost or
repeated task left behind is never read. Reading plans byte ranges over the
archives of a directory: a range reads the members whose headers lie in it, in
batches of bounded size, and tries each member again by its offset, by itself.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .kernel import buffers
from .shared import fresh, text_of

WIDTH = 192
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "name string, archive string, offset long, media binary, error string"


def filesystem(path: str):
    """The file system of a path or URI, and the path in it: file, hdfs, s3 and what else Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(raw: bytes) -> bytes:
    """raw with spaces up to a positive multiple of WIDTH bytes."""
    return raw + b" " * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG, WIDTH samples a row, of a payload whose length is a multiple of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of such an image, by row; checks every chunk's CRC."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's CRC differs")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not 8-bit grey")
            shape = height, width
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 by 8 grid are brighter than the image's mean; then mean and deviation."""
    down = np.linspace(0, samples.shape[0], 9)
    grid = np.zeros((8, 8))
    for i in range(8):
        a = min(int(down[i]), samples.shape[0] - 1)
        part = samples[a : max(a + 1, int(down[i + 1]))]
        grid[i] = part.reshape(len(part), 8, -1).mean((0, 2))
    mean = float(samples.mean())
    bits = int("".join("1" if x else "0" for x in (grid > mean).ravel()), 2)
    return f"{bits:016x}-{mean:.2f}-{float(samples.std()):.2f}"


class Archives(DataSource):
    """Format ``siftwood_archive``: directories of archives, with name and media of each member.

    Options: path; rangeBytes; tries; errors = "raise" (default), or "row" for
    a row with its error and no media where a member can't be read.
    """

    @classmethod
    def name(cls) -> str:
        return "siftwood_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options["path"], schema.names)


@dataclass
class Range(InputPartition):
    archive: str
    begin: int
    end: int

    def __init__(self, archive: str, begin: int, end: int):
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))
        self.errors = options.get("errors", "raise")

    def partitions(self):
        from pyarrow import fs

        store, top = filesystem(self.path)
        sizes = {f.path: f.size for f in store.get_file_info(fs.FileSelector(top)) if f.path.endswith(".zip")}
        named = [f.path for f in store.get_file_info(fs.FileSelector(top)) if f.path.endswith(".manifest")]
        if named:
            kept = set()
            for m in named:
                with store.open_input_stream(m) as f:
                    kept |= set(json.loads(f.read()))
            sizes = {p: n for p, n in sizes.items() if p.rpartition("/")[2] in kept}
        return [Range(p.rpartition("/")[2], a, min(a + self.range_bytes, n)) for p, n in sorted(sizes.items()) for a in range(0, n, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        store, top = filesystem(self.path)
        path = f"{top}/{partition.archive}"
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            members = [m for m in z.infolist() if partition.begin <= m.header_offset < partition.end]
        held, size = [], 0
        for m in sorted(members, key=lambda m: m.header_offset):
            media, error = self._member(store, path, m)
            if error and self.errors == "raise":
                raise OSError(f"{partition.archive} at {m.header_offset}: {error}")
            held.append((m.filename, partition.archive, m.header_offset, media, error))
            size += len(media or b"")
            if size >= BATCH_BYTES or len(held) >= 4096:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    def _member(self, store, path: str, m: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """A member by its offset alone; each try opens the archive anew, but for the first."""
        error = None
        for k in range(self.tries):
            try:
                f = self._open(store, path, again=k > 0)
                head = f.read_at(30, m.header_offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member's header")
                n, extra = struct.unpack("<HH", head[26:30])
                media = f.read_at(m.compress_size, m.header_offset + 30 + n + extra)
                if len(media) != m.file_size or zlib.crc32(media) != m.CRC:
                    raise OSError("the member's CRC differs")
                return media, None
            except (OSError, struct.error, pa.ArrowInvalid) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def _open(self, store, path: str, again: bool):
        if again or getattr(self, "_held", (None,))[0] != path:
            self._held = (path, store.open_input_file(path))
        return self._held[1]


def _batch(held: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], ["name", "archive", "offset", "media", "error"])


class Written(WriterCommitMessage):
    def __init__(self, archive: str | None):
        self.archive = archive


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator):
        store, top = filesystem(self.path)
        archive = z = out = None
        for batch in iterator:
            if batch.num_rows and z is None:
                store.create_dir(top, recursive=True)
                archive = f"{uuid.uuid4().hex}.zip"
                out = store.open_output_stream(f"{top}/{archive}")
                z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
            names, media = batch.column(self.names.index("name")), batch.column(self.names.index("media"))
            for n, m in zip(names.to_pylist(), media, strict=True):
                z.writestr(zipfile.ZipInfo(n), m.as_buffer().to_pybytes())
        if z is not None:
            z.close()
            out.close()
        return Written(archive)

    def commit(self, messages):
        store, top = filesystem(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{uuid.uuid4().hex}.manifest") as f:
            f.write(json.dumps([m.archive for m in messages if m is not None and m.archive]).encode())

    def abort(self, messages):
        store, top = filesystem(self.path)
        for m in messages:
            if m is not None and m.archive:
                store.delete_file(f"{top}/{m.archive}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)


def store_texts(docs: DataFrame, path: str) -> None:
    """Write each text's payload as a member ``{doc_id}_{bytes}_{row}.png`` of the archives under path; a null text is empty."""
    register(docs.sparkSession)

    def run(it):
        row = 0
        for batch in it:
            raw, offsets = buffers(batch.column("text"))
            data, ids = raw.tobytes(), batch.column("doc_id").to_pylist()
            for a in range(0, len(ids), 512):
                names, media = [], []
                for k in range(a, min(a + 512, len(ids))):
                    own = data[offsets[k] : offsets[k + 1]]
                    names.append(f"{'null' if ids[k] is None else ids[k]}_{len(own)}_{row}.png")
                    media.append(encode(pad(own)))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(media, pa.binary())], ["name", "media"])

    text_of(docs).mapInArrow(run, "name string, media binary").write.format("siftwood_archive").mode("append").save(path)


def load(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("siftwood_archive").options(**options).load(path)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as media, read it back, and compute from what was read.

    One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32 (of the payload's last 16 bytes), media_bytes, media_sha256,
    feature. A null or empty text is 192 spaces. Repeated rows give repeated
    rows; a missing id stays null. Only ``doc_id`` and ``text`` are read. An
    empty table gives an empty result. The archives are in the shared folder.
    """
    spark = docs.sparkSession
    path = fresh(spark, "media")
    store_texts(docs, path)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(it):
        for batch in it:
            out = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media"), strict=True):
                media = media.as_buffer().to_pybytes()
                samples = decode(media)
                payload = np.ascontiguousarray(samples).tobytes()
                doc, n, _ = name.split("_")
                out.append((None if doc == "null" else int(doc), int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return load(spark, path).select("name", F.col("media")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
