"""Token-ID output: zstandard-compressed documents under one shared dictionary, with an offset index in each file.

A file holds, in ascending order of document id: a magic number, the SHA-256 of the dictionary, one zstandard
frame for each document (its ids as little-endian unsigned integers), an index block (document ids, frame
offsets, token counts), and a footer with the place of the index. One document is read by two seeks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm.common import Files, caches_of, fresh_dir, partitions, small_batches, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END = 2
MAGIC = b"LTOK0001"
FOOTER = "<QQ8s"
#: The dictionary is trained on so many documents at most, on a window of so many characters anywhere in each, and has so
#: many bytes at most. It changes the size of the files alone: any dictionary gives the same ids back.
TRAIN_DOCS, WINDOW, DICT_BYTES = 1_000, 8_192, 65_536
LEVEL = 3
#: Units that are remembered (about 60 MB), slots of their table (a power of 2), and bytes that are read at once, about.
CACHE, SLOTS, CHUNK = 1_500_000, 22, 1 << 18
U = np.uint64
FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
#: Kinds of bytes: white space that parts units, letters, ASCII punctuation other than an apostrophe, anything else.
SPACE, LETTER, MARK, OTHER = 0, 1, 4, 16
KIND = np.array([SPACE if b in b" \t\n\r" else LETTER if chr(b).isascii() and chr(b).isalpha() else MARK if 33 <= b <= 126 and b != 39 and not chr(b).isalnum() else OTHER for b in range(256)], np.uint8)
#: Second bytes after 0xC3 that make a letter: U+00C0 to U+00FF but for the signs of multiplication and division.
LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
#: A random number for each byte, one table for each factor.
BYTES = [np.random.default_rng(k).integers(0, 1 << 64, 256, np.uint64) for k in (1, 2)]
MANIFEST = "part int, file string, first_doc long, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long"


class Encoder:
    """The tokenizers library behind a cache by units, whole columns at a time.

    The vocabulary's normaliser and pre-tokenizer drop white space and part letters from ASCII punctuation (but for an
    apostrophe), and no token crosses such a place; so a text's ids are those of its units in a row. Units are found,
    hashed (by two numbers, 128 bits) and looked up by numpy; the library encodes those that are new.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = "<u2" if max(names.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for x, i in names.items() if x.endswith("</w>")]] = True
        #: Where one stands, in any case, the library reads the text whole.
        self.special = [str(t).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        self._grow(CHUNK)

    def _clear(self) -> None:
        self.table = np.full(1 << SLOTS, -1, np.int32)
        self.known, self.used = 0, 0
        self.first, self.second = np.zeros(CACHE, U), np.zeros(CACHE, U)
        self.start, self.length = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int64)
        self.pool = np.zeros(4 * CACHE, self.width)

    def _grow(self, n: int) -> None:
        self.up, self.down = [], []
        for f in FACTORS:
            inverse = U(pow(int(f), -1, 1 << 64))
            self.up.append(np.cumprod(np.append(U(1), np.full(n, f)), dtype=U))
            self.down.append(np.cumprod(np.append(U(1), np.full(n, inverse)), dtype=U))

    def _find(self, h: np.ndarray) -> np.ndarray:
        out, open_, step = np.full(len(h), -1), np.arange(len(h)), 0
        while len(open_):
            at = self.table[((h[open_] >> U(64 - SLOTS)).astype(np.int64) + step) & ((1 << SLOTS) - 1)]
            hit = (at >= 0) & (self.first[at] == h[open_])
            out[open_[hit]] = at[hit]
            open_, step = open_[(at >= 0) & ~hit], step + 1
        return out

    def _put(self, first: np.ndarray, second: np.ndarray, ids: list[np.ndarray]) -> None:
        """Remembers new units; first has no value twice."""
        new, size = np.arange(self.known, self.known + len(first)), np.array([len(x) for x in ids])
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(max(len(self.pool), len(flat)), self.width))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[new], self.second[new], self.length[new], self.start[new] = first, second, size, self.used + np.cumsum(size) - size
        self.known, self.used = self.known + len(first), self.used + len(flat)
        open_, step = np.arange(len(first)), 0
        while len(open_):
            at = ((first[open_] >> U(64 - SLOTS)).astype(np.int64) + step) & ((1 << SLOTS) - 1)
            free = self.table[at] < 0
            self.table[at[free]] = new[open_[free]]
            open_, step = open_[self.table[at] != new[open_]], step + 1

    def _library(self, units: list[bytes], plain: np.ndarray) -> list[np.ndarray]:
        """The ids of each unit; plain units (one kind of character) are one word each, and are encoded in one text."""
        out: list[np.ndarray] = [np.zeros(0, self.width)] * len(units)
        at = np.flatnonzero(plain)
        if len(at):
            ids = np.array(self.tokenizer.encode(" ".join(units[i].decode() for i in at), add_special_tokens=False).ids, self.width)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(at):
                for i, x in zip(at.tolist(), np.split(ids, ends[:-1]), strict=True):
                    out[i] = x
            else:
                plain = np.zeros(len(units), bool)
        rest = np.flatnonzero(~plain)
        for i, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.width)
        return out

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts that lie in data between the offsets at."""
        if len(data) >= len(self.up[0]):
            self._grow(2 * len(data))
        kind = KIND[data]
        pair = np.flatnonzero((data[:-1] == 0xC3) & LATIN[data[1:]])
        kind[pair] = kind[pair + 1] = LETTER
        inside = kind != SPACE
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | (kind[1:] + kind[:-1] == LETTER + MARK)
        starts = at[:-1][at[:-1] < len(data)]
        begins[starts] = inside[starts]
        start = np.flatnonzero(begins)
        # A unit ends where the next begins, at white space or with its text.
        stops = np.append(~inside | begins, True)
        stops[at] = True
        edge = np.flatnonzero(stops)
        stop = edge[np.searchsorted(edge, start, side="right")]
        h = []
        for up, down, byte in zip(self.up, self.down, BYTES, strict=True):
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(byte[data] * up[: len(data)], out=sums[1:])
            x = (sums[stop] - sums[start]) * down[start]
            h.append((x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9))
        found = self._find(h[0])
        miss = np.flatnonzero(found < 0)
        if len(miss):
            first, one = np.unique(h[0][miss], return_index=True)
            one = miss[one]
            if self.known + len(one) > CACHE:
                self._clear()
                first, one = np.unique(h[0], return_index=True)
            raw = data.tobytes()
            mixed = np.append(0, np.cumsum(np.append(kind[1:] != kind[:-1], False)))
            plain = (mixed[stop[one] - 1] == mixed[start[one]]) & ((kind[start[one]] == LETTER) | (kind[start[one]] == MARK))
            self._put(first, h[1][one], self._library([raw[a:z] for a, z in zip(start[one].tolist(), stop[one].tolist(), strict=True)], plain))
            found = self._find(h[0])
        clash = np.flatnonzero(self.second[found] != h[1])
        size = self.length[found]
        total = int(size.sum())
        ids = self.pool[np.repeat(self.start[found] - np.cumsum(size) + size, size) + np.arange(total)]
        bound = np.append(0, np.cumsum(size))[np.searchsorted(start, at)]
        out = [ids[a:z] for a, z in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        for i in set((np.searchsorted(at, start[clash], side="right") - 1).tolist()):  # two units with one hash
            out[i] = self._whole(data[at[i] : at[i + 1]].tobytes())
        return out

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.width)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as bytes; null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j = min(max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1), i + CACHE)
            some = data[at[i] : at[j]]
            if at[j] - at[i] > CACHE:  # a long text might have more units than the cache takes
                out += [self._whole(data[a:z].tobytes()) for a, z in zip(at[i:j], at[i + 1 : j + 1], strict=True)]
                i = j
                continue
            ids = self._chunk(some, at[i : j + 1] - at[i])
            low = some.tobytes().lower()
            if any(x in low for x in self.special):
                for k in range(i, j):
                    own = low[at[k] - at[i] : at[k + 1] - at[i]]
                    if any(x in own for x in self.special):
                        ids[k - i] = self._whole(data[at[k] : at[k + 1]].tobytes())
            out += ids
            i = j
        return [x.tobytes() for x in out]


#: A worker's encoders. The driver puts none here: where executors lack this module, its tables (87 MB) would go to tasks with their code.
_encoders: dict[str, Encoder] = {}


def _load(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = _load(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample: the TRAIN_DOCS documents whose ids have the least hashes, of each a window of
    WINDOW characters that begins anywhere in the whole text, as a hash says.

    Too few or too short documents to train on give the empty dictionary.
    """
    ids = docs.filter("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.join(F.broadcast(ids), "doc_id")  # TRAIN_DOCS rows at most
    begin = 1 + F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1)
    texts = texts.groupBy("doc_id").agg(F.max(F.substring("text", begin.cast("int"), F.lit(WINDOW))).alias("text"))
    rows = sorted(texts.collect(), key=lambda r: r.doc_id)
    samples = [x for x in _load(path).encode(pa.array([r.text for r in rows], pa.string())) if x]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, directory: str, vocabulary: str | None = None, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes token files in ascending order of document id and returns their manifest (a row for each file).

    Texts are dealt once, by range of id, and sorted in each partition; every task writes one file under a name of
    its own attempt, and only files that the manifest names count, so lost executors and repeated tasks do no
    harm. Null texts count as empty and get the end id alone; null ids come first; repeated ids keep all rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or tokenizer_path(VOCABULARY)
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    raw = train_dictionary(narrow, path)
    digest = hashlib.sha256(raw).digest()
    store = Files(directory)
    with store.create(f"dictionary-{digest.hex()}") as f:
        f.write(raw)
    store.publish(f"dictionary-{digest.hex()}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("tokenfiles", _encoders.clear)
        enc, task = encoder(path), TaskContext.get()
        shared = _dict(raw)
        if shared:
            shared.precompute_compress(level=LEVEL)  # else every frame would digest the dictionary again
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True).compress
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, end = Files(directory), np.array([end_id], enc.width).tobytes()
        ids, valid, sizes, counts = [], [], [], []
        f = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if f is None:
                f = files.create(name)
                f.write(MAGIC + digest)
            frames = []
            for x in enc.encode(batch.column(1)):
                counts.append(len(x) // len(end) + 1)
                frames.append(compress(x + end))
            f.write(b"".join(frames))
            sizes += map(len, frames)
            valid.append(np.array(batch.column(0).is_valid()))
            ids.append(batch.column(0).fill_null(0).to_numpy())
        if f is None:
            return
        offsets = np.cumsum([len(MAGIC) + len(digest), *sizes]).astype("<u8")
        block = zlib.compress(b"".join([enc.width.encode(), struct.pack("<Q", len(sizes)), np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(valid).astype("u1").tobytes(), offsets.tobytes(), np.array(counts, "<u8").tobytes()]), 1)
        f.write(block)
        f.write(struct.pack(FOOTER, int(offsets[-1]), len(block), MAGIC))
        f.close()
        files.publish(name)
        row = [task.partitionId(), name, int(ids[0][0]), len(sizes), sum(counts), int(offsets[-1]) + len(block) + struct.calcsize(FOOTER)]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "file", "first_doc", "n_docs", "n_tokens", "n_bytes"])

    dealt = narrow.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, MANIFEST)


class TokenFile:
    """Random access to one file."""

    def __init__(self, files: Files, name: str, size: int):
        self.f = files.open(name)
        self.f.seek(size - struct.calcsize(FOOTER))
        at, length, magic = struct.unpack(FOOTER, self.f.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.f.seek(0)
        head = self.f.read(len(MAGIC) + 32)
        with files.open(f"dictionary-{head[len(MAGIC) :].hex()}") as d:
            raw = d.read()
        if hashlib.sha256(raw).digest() != head[len(MAGIC) :]:
            raise ValueError("the dictionary does not have the hash that the file names")
        self.decompress = zstandard.ZstdDecompressor(dict_data=_dict(raw)).decompress
        self.f.seek(at)
        block = zlib.decompress(self.f.read(length))
        self.width, n = block[:3].decode(), struct.unpack_from("<Q", block, 3)[0]
        take = lambda kind, start, k: np.frombuffer(block, kind, k, start)
        self.ids, self.valid = take("<i8", 11, n), take("u1", 11 + 8 * n, n).astype(bool)
        self.offsets, self.counts = take("<u8", 11 + 9 * n, n + 1).astype(np.int64), take("<u8", 19 + 17 * n, n).astype(np.int64)

    def frames(self, step: int = 256) -> Iterator[tuple[int, bytes]]:
        for i in range(0, len(self.ids), step):
            j = min(len(self.ids), i + step)
            self.f.seek(int(self.offsets[i]))
            block = self.f.read(int(self.offsets[j] - self.offsets[i]))
            for k in range(i, j):
                yield k, self.decompress(block[self.offsets[k] - self.offsets[i] : self.offsets[k + 1] - self.offsets[i]])

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of a document, by its index entry alone; an array for each row with this id."""
        out = []
        for k in np.flatnonzero(self.valid & (self.ids == doc_id)):
            self.f.seek(int(self.offsets[k]))
            out.append(np.frombuffer(self.decompress(self.f.read(int(self.offsets[k + 1] - self.offsets[k]))), self.width))
        return out


def read(spark: SparkSession, directory: str, manifest: list, with_ids: bool = False) -> DataFrame:
    """The documents of the files that a manifest names (one row a file): doc_id, start, n_tokens, ids_crc32, n_bytes, and ids if asked."""
    small_batches(spark)
    rows, start = [], 0
    for m in sorted(manifest, key=lambda m: m.part):
        rows.append((m.file, m.n_bytes, start))
        start += m.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(directory)
        for batch in batches:
            for name, size, base in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                t = TokenFile(files, name, size)
                starts = base + np.cumsum(t.counts) - t.counts
                out: list[tuple] = []
                for k, data in t.frames():
                    ids = np.frombuffer(data, t.width).astype("<u4")
                    out.append((k, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                    if len(out) == 4096 or k == len(t.ids) - 1 or with_ids and len(out) == 256:
                        ks = np.array([x[0] for x in out])
                        cols = [pa.array(t.ids[ks], pa.int64(), mask=~t.valid[ks]), pa.array(starts[ks], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array(t.offsets[ks + 1] - t.offsets[ks], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"]
                        if with_ids:
                            cols.append(pa.array([x[3] for x in out], pa.list_(pa.int32())))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        out = []

    files = spark.createDataFrame(rows, "file string, n_bytes long, start long")
    return files.repartition(max(1, min(len(rows), partitions(spark)))).mapInArrow(run, ROWS + (", ids array<int>" if with_ids else ""))


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents to a new folder of the shared store and reads the files back."""
    spark = docs.sparkSession
    directory = fresh_dir(spark, "tokens")
    manifest = write(docs, directory, vocabulary).collect()  # a row for each file
    return read(spark, directory, manifest)
