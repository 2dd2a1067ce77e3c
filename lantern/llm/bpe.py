"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes the tokens of each distinct word. Byte-pair merges only ever grow tokens, so a
proposal is right if, and only if, every token is what its own bytes merge to and no merge across two adjacent
tokens would come before both have been completed. That test is done for all adjacent pairs of a batch at once with
numpy; words that fail it are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lantern.llm.common import caches_of, small_batches, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Cuts a text where plain white space follows anything else; no word of WORDS crosses such a place.
PIECES = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: White space beyond the plain: where there is any, a text is cut by WORDS itself.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
CACHE = 400_000
LATE = np.int64(1) << 60
ID_BITS = 24
ID_MASK, LAST = (1 << ID_BITS) - 1, 1 << 60

OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, rest = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + rest)
            rest += 1
    return out


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """A byte-level BPE vocabulary file, able to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        to_byte = {c: b for b, c in enumerate(alphabet)}
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = max(*vocab.values(), *self.special.values()) + 1
        self.token = [b""] * n
        for t, i in vocab.items():
            self.token[i] = bytes(to_byte[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.byte_id = [vocab[c] for c in alphabet]
        self.n = n
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (x, y) in enumerate(pairs):
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            self.merge[a, b] = (r, c)
            if self.rank[c] < 0:
                self.left[c], self.right[c], self.rank[c] = a, b, r
        #: The same in one number for each pair, rank first.
        self.step = {p: r << ID_BITS | c for p, (r, c) in self.merge.items()}
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        made = np.flatnonzero(self.rank >= 0)
        grows = (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        self.sound = np.zeros(n, bool)
        self.sound[self.byte_id] = True
        alone = np.zeros(n, bool)
        alone[made] = self.compatible(self.left[made], self.right[made], parts=True) & grows
        for c in made[np.argsort(self.rank[made])]:
            self.sound[c] = alone[c] and self.sound[self.left[c]] and self.sound[self.right[c]]
        # The test holds only if no merge takes a token that a later merge makes.
        self.monotone = bool(grows.all())
        self.lookup = {self.token[i]: int(i) for i in np.flatnonzero(self.sound)} if self.monotone else {}
        #: The length of the longest token that begins with three given bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.lookup:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def ranks_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.n + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray, parts: bool = False) -> np.ndarray:
        """For each i, whether the bytes of a[i] and b[i] side by side merge to just these two tokens.

        Walks back in time from the finished pair: of the two tokens that meet, the one made last is split
        again, and any merge that was possible while both stood there is a conflict. Time is (rank, place): a
        merge inside the left token comes before one across, and that before one inside the right token, at the
        same rank. parts: the merge of a and b themselves is what is wanted, and no conflict.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        gone_x, gone_y = np.full(len(x), LATE), np.full(len(x), LATE)
        first = parts
        while len(live):
            u, v = x[live], y[live]
            r = self.ranks_of(u, v)
            t = 4 * r + 1
            bad = (r >= 0) & (t < gone_x[live]) & (t < gone_y[live])
            if first:
                top, first = t, False
                gone_x[live] = gone_y[live] = top + 1
                bad[:] = False
            ok[live[bad]] = False
            made_x = np.where(self.rank[u] >= 0, 4 * self.rank[u], -1)
            made_y = np.where(self.rank[v] >= 0, 4 * self.rank[v] + 2, -1)
            on = ~bad & ((made_x >= 0) | (made_y >= 0))
            in_x = on & (made_x > made_y)
            in_y = on & ~in_x
            gone_x[live[in_x]], x[live[in_x]] = made_x[in_x], self.right[u[in_x]]
            gone_y[live[in_y]], y[live[in_y]] = made_y[in_y], self.left[v[in_y]]
            live = live[on]
        return ok

    def propose(self, word: bytes) -> list[int]:
        lookup, reach, out, i, n = self.lookup, self.reach, [], 0, len(word)
        while i < n:
            j = min(n, i + reach.get(word[i : i + 3], 2))
            while word[i:j] not in lookup:
                j -= 1
            out.append(lookup[word[i:j]])
            i = j
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank and leftmost first: by scanning a short word, with a heap over a linked list for a long one."""
        ids = [self.byte_id[b] for b in word]
        n, merge = len(ids), self.merge
        if n <= 48:
            step, none = self.step, LAST
            found = [step.get(p, none) for p in zip(ids, ids[1:])]
            while found and (best := min(found)) != none:
                i = found.index(best)
                made = best & ID_MASK
                del ids[i], found[i]
                ids[i] = made
                if i:
                    found[i - 1] = step.get((ids[i - 1], made), none)
                if i < len(found):
                    found[i] = step.get((made, ids[i + 1]), none)
            return ids
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Puts the tokens of new words into the cache."""
        raw = [w.encode() for w in words]
        if not self.monotone:
            for w, b in zip(words, raw, strict=True):
                self.words[w] = pack(self.merged(b))
            return
        said = [self.propose(b) for b in raw]
        owner = np.repeat(np.arange(len(said)), [len(s) - 1 for s in said])
        a = np.array([t for s in said for t in s[:-1]], np.int64)
        b = np.array([t for s in said for t in s[1:]], np.int64)
        wrong: set[int] = set()
        if len(a):
            key, place = np.unique(a * self.n + b, return_inverse=True)
            known = [self.pairs.get(k) for k in key.tolist()]
            new = np.flatnonzero([x is None for x in known])
            if len(new):
                fine = self.compatible(key[new] // self.n, key[new] % self.n)
                if len(self.pairs) > 4 * CACHE:
                    self.pairs.clear()
                for i, k, x in zip(new.tolist(), key[new].tolist(), fine.tolist(), strict=True):
                    known[i] = self.pairs[k] = x
            wrong = set(owner[~np.array(known, bool)[place]].tolist())
        for i, w in enumerate(words):
            self.words[w] = pack(self.merged(raw[i]) if i in wrong else said[i])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        parts = []
        for text in texts:
            cut = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            found: list[str | int] = []
            for i, x in enumerate(cut):
                if i % 2:
                    found.append(self.special[x])
                else:
                    found += WORDS.findall(x) if ODD_SPACE.search(x) else PIECES.findall(x)
            parts.append(found)
        hits = [list(map(self.pieces.get, p)) for p in parts]
        new = {x for p, h in zip(parts, hits, strict=True) if None in h for x, y in zip(p, h, strict=True) if y is None}
        words: dict[str, list[str]] = {x: [x] if x.isalpha() or x[0] == " " and x[1:].isalpha() else WORDS.findall(x) for x in new if isinstance(x, str)}
        unknown = list(set().union(*words.values()).difference(self.words))
        for i in range(0, len(unknown), 20_000):
            self.learn(unknown[i : i + 20_000])
        for x, ws in words.items():
            self.pieces[x] = b"".join([self.words[w] for w in ws])
        for x in new:
            if isinstance(x, int):
                self.pieces[x] = x.to_bytes(4, "little")
        return [b"".join(map(self.pieces.__getitem__, p) if None in h else h) for p, h in zip(parts, hits, strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also ids (array of int). A null text
    counts as empty: no tokens, and the hashes of nothing. Null and repeated ids are kept, a row for each row;
    other columns of docs are left out, whatever their names. Only narrow rows leave Python; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("bpe", _codecs.clear)
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = c.encode_batch(texts)
            back = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
            cols = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, OUT + (", ids array<int>" if keep_ids else ""))


def decode(tokens: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of each array of ids: doc_id, text. A null array gives an empty text."""
    path = vocabulary or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("bpe", _codecs.clear)
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
