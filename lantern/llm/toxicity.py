"""Toxicity: bags of character n-grams averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed n-grams (and of itself), a window's the mean of its
words', and a softmax over it says how likely the window is toxic; a document is as toxic as its worst window. Windows
are short, as one bad word makes a text toxic and would be lost in the mean of a long one.
Embeddings and softmax are trained together, so misspellings that were never seen share vectors with their models.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import caches_of, small_batches

WORD = re.compile(r"\w+")
MIN_GRAM, MAX_GRAM, BUCKETS, WIDTH = 3, 5, 1 << 17, 4
#: Words in a window; the windows of a document do not overlap.
WINDOW = 2
#: The sample that is fitted: so many toxic and so many clean labelled documents at most, of least hash, all of their texts; a
#: document with which the sample would have more characters than this is left out, and so teaches nothing rather than a part.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2_000, 2_000, 15_000_000
#: Adam: rounds on all windows and in all, first step (it falls to 0), and the ridge (shared out over the
#: documents) that keeps down what only a few of them show.
WARM, ROUNDS, STEP, RIDGE, SEED = 10, 60, 0.4, 0.03, 17
#: The least share of toxic documents in the loss, and the documents an n-gram has to be in.
SHARE, MIN_DOCS = 0.35, 3
#: Words of the sample, and distinct words, that are worked on at once.
BLOCK, PIECE = 100_000, 10_000
CACHE = 200_000

OUT = "doc_id long, held_out boolean, score double, predicted int"


#: Factor of the polynomial hash of an n-gram, and its powers for the places of a word; longer words are cut into pieces.
FACTOR, LONGEST = np.uint64(0x9E3779B97F4A7C15), 64
POWERS = np.cumprod(np.append(np.uint64(1), np.full(LONGEST + 1, FACTOR)), dtype=np.uint64)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all n-grams of all words (LONGEST characters at most, as from words_of) and of the words themselves,
    and the place in words that each is from."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(w) for w in marked])
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    whole = np.add.reduceat(code * POWERS[np.arange(len(code)) - start[owner]], start)
    buckets, owners = [_bucket(whole + np.uint64(1))], [np.arange(len(words))]
    h = code
    for n in range(2, MAX_GRAM + 1):
        h = h[:-1] * FACTOR + code[n - 1 :]
        if n >= MIN_GRAM:
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            buckets.append(_bucket(h[inside] * FACTOR + np.uint64(n)))
            owners.append(owner[inside])
    return np.concatenate(buckets), np.concatenate(owners)


def words_of(text: str | None) -> list[str]:
    """The words of a text; one of more than LONGEST characters as pieces, which overlap so that each n-gram is in one."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    step = LONGEST - MAX_GRAM + 1
    return [w[i : i + LONGEST] for w in words for i in range(0, max(1, len(w) - MAX_GRAM + 1), step)]


@dataclass
class Model:
    """What is left of embeddings and softmax for scoring: their product for each bucket, and the bias."""

    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.cache = {}

    def scores(self, texts: list[str | None]) -> list[float]:
        """How likely each text is toxic; one without words gets the bias, below 0.5."""
        lists = [words_of(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = list(set().union(*lists).difference(cache))
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            bucket, owner = grams(some)
            means = np.bincount(owner, self.weight[bucket], len(some)) / np.bincount(owner, minlength=len(some))
            cache.update(zip(some, means.tolist(), strict=True))
        out = []
        for words in lists:
            worst = min(0.0, -1.0 - self.bias)
            if words:
                starts = np.arange(0, len(words), WINDOW)
                values = np.fromiter(map(cache.__getitem__, words), float, len(words))
                worst = (np.add.reduceat(values, starts) / np.diff(np.append(starts, len(words)))).max()
            out.append(float(1 / (1 + np.exp(-(worst + self.bias)))))
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Full-batch Adam with a ridge; after a warm-up, a toxic document teaches by its worst window alone.

    N-grams of fewer than MIN_DOCS documents keep no embedding: their noise would be learnt by heart.
    """
    rng = np.random.default_rng(SEED)
    ids: dict[str, int] = {}
    occurrence, words_in, labels = array("i"), array("i"), []
    for text, y in zip(texts, toxic, strict=True):
        words = words_of(text)
        occurrence.extend(ids.setdefault(w, len(ids)) for w in words)
        if words:
            words_in.append(len(words))
            labels.append(y)
    y = np.array(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if len(y) and y[0] else -4.0)
    occ, size, n = np.frombuffer(occurrence, np.int32), np.frombuffer(words_in, np.int32).astype(np.int64), len(ids)
    # Blocks of whole documents and pieces of the words: nothing is as long as the sample but its words' numbers.
    first_word = np.append(0, np.cumsum(size))
    cuts = [0]
    while cuts[-1] < len(size):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first_word, first_word[cuts[-1]] + BLOCK, side="right")) - 1))
    blocks = list(zip(cuts[:-1], cuts[1:], strict=True))
    docs_of_word = np.zeros(n, np.int64)
    for i, j in blocks:
        pairs = np.unique(np.repeat(np.arange(j - i), size[i:j]) * n + occ[first_word[i] : first_word[j]])
        docs_of_word += np.bincount(pairs % n, minlength=n)
    names, docs_of_gram, pieces = list(ids), np.zeros(BUCKETS), []
    del ids
    for k in range(0, n, PIECE):
        gram, owner = grams(names[k : k + PIECE])
        docs_of_gram += np.bincount(gram, docs_of_word[k : k + PIECE][owner], BUCKETS)
    used = np.flatnonzero(docs_of_gram >= MIN_DOCS)
    for k in range(0, n, PIECE):
        gram, owner = grams(names[k : k + PIECE])
        m, shown = len(names[k : k + PIECE]), docs_of_gram[gram] >= MIN_DOCS
        pieces.append((k, m, np.searchsorted(used, gram[shown]).astype(np.int32), owner[shown].astype(np.int32), 1 / np.bincount(owner, minlength=m)))
    del names

    def words_from(emb: np.ndarray) -> np.ndarray:
        return np.concatenate([np.stack([np.bincount(owner, r[place], m) * share for r in emb]) for _, m, place, owner, share in pieces], axis=1)

    emb, soft, bias = rng.normal(size=(WIDTH, len(used))) * 0.01, rng.normal(size=(WIDTH, 2)), np.zeros(2)
    means, squares = [[np.zeros_like(q) for q in (emb, soft, bias)] for _ in range(2)]
    share = max(SHARE, y.mean())
    # The weights of a document's windows add up to 1, so these are shared among the documents of each class.
    of_doc = np.where(y == 1, share / (y == 1).sum(), (1 - share) / (y == 0).sum())
    for t in range(ROUNDS):
        vectors = words_from(emb)
        dword, grads = np.zeros_like(vectors), [np.zeros_like(emb), np.zeros_like(soft), np.zeros_like(bias)]
        for i, j in blocks:
            some, n_win = occ[first_word[i] : first_word[j]], -(-size[i:j] // WINDOW)
            doc, doc_start = np.repeat(np.arange(j - i), n_win), np.cumsum(n_win) - n_win
            start = (first_word[i:j] - first_word[i])[doc] + (np.arange(len(doc)) - doc_start[doc]) * WINDOW
            win_len = np.diff(np.append(start, len(some)))
            h = np.add.reduceat(vectors[:, some], start, axis=1) / win_len
            logit = soft.T @ h + bias[:, None]
            p = 1 / (1 + np.exp(np.clip(logit[0] - logit[1], -30, 30)))
            bad, weight = y[i:j][doc] == 1, 1 / n_win[doc]
            if t >= WARM:
                worst = np.maximum.reduceat(p, doc_start)
                first = np.zeros(len(p))
                first[np.minimum.reduceat(np.where(p >= worst[doc], np.arange(len(p)), len(p) - 1), doc_start)] = 1
                weight = np.where(bad, first, 0.5 * weight + 0.5 * first)
            d = (p - bad) * weight * of_doc[i:j][doc]
            d2 = np.stack([-d, d])
            back = np.repeat((soft @ d2) / win_len, win_len, axis=1)
            for r, x in zip(dword, back, strict=True):
                r += np.bincount(some, x, n)
            grads[1] += h @ d2.T
            grads[2] += d2.sum(1)
        for k, m, place, owner, part in pieces:
            for r, x in zip(grads[0], dword[:, k : k + m] * part, strict=True):
                r += np.bincount(place, x[owner], len(used))
        grads[0] += RIDGE / len(y) * emb
        pace = STEP * (1 - t / ROUNDS)
        for q, g, m, v in zip((emb, soft, bias), grads, means, squares, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            q -= pace * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.98 ** (t + 1))) + 1e-12)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = (soft[:, 1] - soft[:, 0]) @ emb
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample of the labelled documents that are not held out, on the whole of their texts.

    Rows without an id or a label are passed over; of several labels for one id, the highest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_toxic"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_toxic").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    some = [known.filter(F.col("_toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    sample = F.broadcast(some[0].union(some[1]))  # TRAIN_TOXIC + TRAIN_CLEAN rows at most
    size = F.greatest(F.char_length(docs[text_col]), F.lit(0))
    # Lengths first, TRAIN_TOXIC + TRAIN_CLEAN of them; then the texts that fit, the classes in turn.
    lengths = docs.select(docs[id_col].cast("long").alias("_id"), size.alias("_size")).join(sample, "_id").groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.max("_size").alias("_size"), F.xxhash64("_id").alias("_hash")).collect()
    ranked = sorted(lengths, key=lambda r: (r._hash, r._id))
    turn = [r for pair in zip_longest(*([r for r in ranked if r._toxic == y] for y in (1, 0))) for r in pair if r]
    chosen, held = [], 0
    for r in turn:
        if held + (r._size or 0) <= TRAIN_CHARS:
            chosen.append((r._id,))
            held += r._size or 0
    ids = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_id long"))
    texts = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_text")).join(ids, "_id").join(sample, "_id")
    rows = texts.groupBy("_id").agg(F.max(F.struct("_toxic", "_text")).alias("x")).select("_id", "x.*").collect()
    rows.sort(key=lambda r: r._id)
    return fit([r._text for r in rows], [r._toxic for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row, by its whole text alone, words of any length included.

    Null and empty texts get the score of the bias, below 0.5. Repeated and null ids are kept (a null id counts as
    not held out); other columns are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        caches_of("toxicity", m.cache.clear)
        for batch in batches:
            s = m.scores(batch.column(2).to_pylist())
            cols = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    i = docs[id_col].cast("long")
    narrow = docs.select(i.alias("doc_id"), F.coalesce(held_out(i), F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    return narrow.mapInArrow(run, OUT)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns whatever their names, that score below 0.5.

    Null and empty texts, and rows with null ids, are scored like any other and so stay; rows that repeat stay or go
    together; texts are read whole; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        caches_of("toxicity", m.cache.clear)
        for batch in batches:
            yield batch.filter(pa.array([x < 0.5 for x in m.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
