"""Media columns: texts as lossless 8-bit images in tar archives, read by a Spark data source of its own.

The source plans byte ranges over the archives of a folder from their member indexes; each range is streamed and
its payload batches cross to Spark through Arrow. A member that cannot be read or decoded is tried again by itself,
at its own offset, and in the end gives a row with an error in place of a payload, so one bad member costs no other.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lantern.llm.common import Files, fresh_dir, small_batches

ALIGN, PAD = 192, b" "
#: An image is so many RGB pixels wide, so that a row holds ALIGN samples.
PIXELS = ALIGN // 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 1
#: Bytes in an archive before the next is begun, in a planned byte range, and in a batch on its way to Spark.
ROLL, RANGE, BATCH = 256 << 20, 16 << 20, 8 << 20
TRIES, WAIT = 3, 0.2
INDEX = np.dtype([("offset", "<u8"), ("size", "<u8"), ("doc_id", "<i8"), ("known", "u1")])
MANIFEST = "archive string, n_members long, n_bytes long"
SCHEMA = "doc_id long, archive string, offset long, media binary, payload binary, n_bytes long, error string"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + PAD * (max(ALIGN, -(-len(raw) // ALIGN) * ALIGN) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An 8-bit RGB image of the payload, rows unfiltered; the length before padding goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ALIGN)
    scan = np.zeros((len(rows), ALIGN + 1), np.uint8)
    scan[:, 1:] = rows
    head = struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(scan.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(png: bytes) -> tuple[int, bytes]:
    """(bytes before padding, samples); every chunk's checksum is verified."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, data, n, high = len(SIGNATURE), [], -1, 0
    while at < len(png):
        (length,) = struct.unpack_from(">I", png, at)
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", png, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk does not have its checksum")
        if kind == b"IHDR":
            high = struct.unpack_from(">II", body)[1]
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    scan = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(high, ALIGN + 1)
    if scan[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return n, scan[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of each colour channel and a 64-bit average hash over a grid of 8 by 8 cells."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, PIXELS, 3)
    total, square = x.sum((0, 1), dtype=np.int64), np.einsum("ijk,ijk->k", x, x, dtype=np.int64)
    n = x.shape[0] * PIXELS
    cut = np.unique(np.linspace(0, len(x), 9).astype(int)[:-1])
    cells = np.add.reduceat(x.sum((2,), dtype=np.int64).reshape(len(x), 8, -1).sum(2), cut, axis=0) / np.diff(np.append(cut, len(x)))[:, None]
    bits = (cells > cells.mean()).ravel()
    code = int("".join("1" if b else "0" for b in bits), 2)
    means = " ".join(f"{t / n:.3f}/{max(0.0, q / n - (t / n) ** 2) ** 0.5:.3f}" for t, q in zip(total.tolist(), square.tolist(), strict=True))
    return f"{means} {code:016x}"


def write(docs: DataFrame, directory: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the texts as images into tar archives with an index beside each; returns the manifest.

    Attempts write under names of their own, and the index is published last: an archive without one is
    left over from a lost task. drop_others() removes what the manifest does not name.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, task = Files(directory), TaskContext.get()
        stem, n, f, at = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, 0
        index: list[tuple] = []

        def close():
            f.write(b"\0" * 1024)
            f.close()
            files.publish(name)
            with files.create(f"{name}.idx") as g:
                g.write(np.array(index, INDEX).tobytes())
            files.publish(f"{name}.idx")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([at + 1024], pa.int64())], names=["archive", "n_members", "n_bytes"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if f is None:
                    name, at, index = f"{stem}-{n:04d}.tar", 0, []
                    f, n = files.create(name), n + 1
                size, payload = padded(text)
                png = to_png(payload, size)
                info = tarfile.TarInfo(f"{len(index):09d}-{'null' if doc_id is None else doc_id}.png")
                info.size = len(png)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                index.append((at + len(head), len(png), doc_id or 0, doc_id is not None))
                block = head + png + b"\0" * (-len(png) % 512)
                f.write(block)
                at += len(block)
                if at >= ROLL:
                    yield close()
                    f = None
        if f is not None:
            yield close()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, MANIFEST)


class ByteRange(InputPartition):
    def __init__(self, archive: str, first: int, last: int):
        self.archive, self.first, self.last = archive, first, last


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.directory = options["path"]
        self.range = int(options.get("rangebytes", RANGE))

    def index(self, files: Files, archive: str) -> np.ndarray:
        with files.open(f"{archive}.idx") as f:
            return np.frombuffer(f.read(), INDEX)

    def partitions(self) -> list[ByteRange]:
        files, out = Files(self.directory), []
        for name, _ in files.list():
            archive = name.removesuffix(".idx")
            if archive == name:
                continue
            ends = self.index(files, archive)
            part = ends["offset"] // self.range
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ends)]
            out += [ByteRange(archive, a, b) for a, b in zip(cut, cut[1:], strict=False) if a < b]
        return out

    def member(self, files: Files, archive: str, entry, png: bytes) -> tuple:
        """Decodes one member; if that fails, reads it alone at its offset and tries again."""
        for k in range(TRIES):
            try:
                if k:
                    time.sleep(WAIT * (k - 1))
                    with files.open(archive) as f:
                        f.seek(int(entry["offset"]))
                        png = f.read(int(entry["size"]))
                n, payload = from_png(png)
                return png, payload, n, None
            except (OSError, ValueError, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, None, None, error

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        files = Files(self.directory)
        entries = self.index(files, partition.archive)[partition.first : partition.last]
        schema = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("n_bytes", pa.int64()), ("error", pa.string())])
        rows: list[tuple] = []
        held, i = 0, 0
        while i < len(entries):
            j, start = i, int(entries["offset"][i])
            while j < len(entries) and (j == i or int(entries["offset"][j] + entries["size"][j]) - start <= BATCH):
                j += 1
            try:
                with files.open(partition.archive) as f:
                    f.seek(start)
                    block = f.read(int(entries["offset"][j - 1] + entries["size"][j - 1]) - start)
            except OSError:
                block = b""
            for e in entries[i:j]:
                at = int(e["offset"]) - start
                got = self.member(files, partition.archive, e, block[at : at + int(e["size"])])
                rows.append((int(e["doc_id"]) if e["known"] else None, partition.archive, int(e["offset"]), *got))
                held += len(got[0] or b"") + len(got[1] or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
            i = j
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read(spark: SparkSession, directory: str) -> DataFrame:
    """The members of the archives of a folder, as SCHEMA; extra files in it are passed over."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(directory)


def drop_others(directory: str, manifest: list) -> None:
    """Removes archives and indexes that no successful task has reported."""
    files, named = Files(directory), {m.archive for m in manifest}
    for name, _ in files.list():
        if name.removesuffix(".idx") not in named:
            files.delete(name)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def digests(members: DataFrame) -> DataFrame:
    """Lengths, hashes and features of members as read; a member with an error has nulls and the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, media, payload, n, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if error is None:
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload), None))
                else:
                    rows.append((doc_id, None, None, None, None, None, None, None, error))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return members.select("doc_id", "media", "payload", "n_bytes", "error").mapInArrow(run, DIGEST)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores every whole text (null: empty) in the shared folder, reads it back through the source, and digests it."""
    spark = docs.sparkSession
    directory = fresh_dir(spark, "media")
    manifest = write(docs, directory).collect()  # a row for each archive
    drop_others(directory, manifest)
    return digests(read(spark, directory))
