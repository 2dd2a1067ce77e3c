"""Language-model scoring: a probabilistic suffix tree over words.

A state of the tree is a context of up to DEPTH words. Grams are counted level by level in one shuffle each: a gram of k + 1
words is a candidate only where the two grams of k words in it are frequent, so the candidates hold every frequent gram.
Frequent means a share of P_MIN of the training tokens, as in the tree's usual definition, so a level has 1 / P_MIN grams
at most, whatever the corpus, and the tree can be built on the driver and broadcast. The counts of all words have no such
bound: they stay in a table, and what documents need of it is joined.

A context's next-symbol distribution gives its frequent continuations a discounted share and shares out the rest as its
longest retained suffix does. A context is retained if its divergence from that suffix, times its count, exceeds what as
many free figures would reach by chance. The root is the smoothed distribution of single words, which knows unseen
words; a text scores the log10 probability of its words and its end, each from the longest retained state before it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import caches_of, small_batches, written

#: Words in a context at most; the share of the training tokens that a gram of the tree has at least, and its least count.
DEPTH, P_MIN, MIN_COUNT = 3, 2.5e-7, 2
#: What smoothing adds to each word of the root, and takes from each continuation of a context.
ADDED, DISCOUNT = 0.1, 0.5
#: The symbol before the first word of a text and after its last: no word is empty.
END = ""
#: Bits for a symbol in a gram's key; symbols and grams of a level are fewer than 1 / P_MIN.
BITS = 24
#: Words or grams that a task holds before it passes them on as partial counts.
HELD = 1 << 21


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text is divisible by ten. A null id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    """Capitals A to Z are lowered; bytes.split() parts at the six signs of white space of ASCII."""
    return text.lower().split()


@dataclass
class Tree:
    """Level k holds the frequent grams of k words: keys (gram before, last word) in order, counts, and for each as a context its suffix, whether it is retained, and log10 of what it leaves to its suffix."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    vocabulary: int
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    suffix: dict[int, np.ndarray] = field(default_factory=dict)
    retained: dict[int, np.ndarray] = field(default_factory=dict)
    left: dict[int, np.ndarray] = field(default_factory=dict)
    #: By level, log10 of P(last word | the words before) for each gram.
    log_p: dict[int, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {w: i for i, w in enumerate(self.words)}
        self.root = self.root_log(self.counts)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "root")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def root_log(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.vocabulary + 1)))

    def symbols(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one row, -1 for words that are not frequent, each text as end, words, end, break (-1); and where each starts."""
        end, get = self.ids.get(END.encode(), -1), self.ids.get
        out: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(out))
            out.append(end)
            out.extend([get(w, -1) for w in words])
            out.append(end)
            out.append(-1)
        return np.array(out, np.int64), np.array(starts, np.int64)

    def grams(self, symbols: np.ndarray, level: int) -> Iterator[np.ndarray]:
        """For levels 1 to level: the number of the frequent gram that ends at each place, or -1."""
        at = symbols
        yield at
        for k in range(2, level + 1):
            before = np.concatenate([[-1], at[:-1]])
            some = np.flatnonzero((before >= 0) & (symbols >= 0) & (at >= 0))
            keys, out = self.keys[k], np.full(len(at), -1, np.int64)
            if len(keys) and len(some):
                wanted = before[some] << BITS | symbols[some]
                found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                out[some] = np.where(keys[found] == wanted, found, -1)
            at = out
            yield at

    def candidates(self, texts: list[list[bytes]], level: int) -> np.ndarray:
        """Keys of the grams of level + 1 words whose first and last level words are frequent grams."""
        symbols, _ = self.symbols(texts)
        *_, at = self.grams(symbols, level)
        before = at[:-1]
        some = np.flatnonzero((before >= 0) & (at[1:] >= 0)) if level > 1 else np.flatnonzero((before >= 0) & (symbols[1:] >= 0))
        return before[some] << BITS | symbols[1:][some]

    def grow(self, level: int, keys: np.ndarray, counts: np.ndarray, of_before: np.ndarray) -> None:
        """Adds the grams of level + 1 words, whose contexts are the grams of level words (of_before: their counts), and tests these contexts."""
        context, word = keys >> BITS, keys & ((1 << BITS) - 1)
        n = len(of_before)
        if level == 1:
            self.suffix[1] = np.zeros(n, np.int64)
            to = word
        else:
            shorter = self.suffix[level][context] << BITS | word
            to = np.searchsorted(self.keys[level], shorter)
        self.keys[level + 1], self.suffix[level + 1] = keys, to
        p = (counts - DISCOUNT) / of_before[context]
        log_below = self.lower(level, context, word)
        taken = np.bincount(context, p, n)
        taken_below = np.minimum(np.bincount(context, 10**log_below, n), 1 - 1e-12)
        left = np.log10(np.maximum(1 - taken, 1e-12)) - np.log10(1 - taken_below)
        gain = np.bincount(context, p * (np.log10(p) - log_below), n) + (1 - taken) * left
        figures = np.bincount(context, minlength=n)
        # Twice the count times the divergence, in nats, against log(N) for each free figure, as the Bayesian criterion has it.
        self.retained[level] = (figures > 0) & (2 * math.log(10) * of_before * gain > figures * math.log(max(self.tokens, 2)))
        self.left[level] = np.where(self.retained[level], left, 0.0)
        self.log_p[level + 1] = np.log10(p)

    def lower(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 P(word | the longest retained proper suffix of the context, a gram of level words)."""
        out = np.zeros(len(word))
        open_ = np.arange(len(word))
        for k in range(level - 1, 0, -1):
            context = self.suffix[k + 1][context]
            known = np.flatnonzero(self.retained[k][context])
            keys, wanted = self.keys[k + 1], context[known] << BITS | word[known]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = keys[at] == wanted
            out[open_[known[hit]]] += self.log_p[k + 1][at[hit]]
            out[open_[known[~hit]]] += self.left[k][context[known[~hit]]]
            goes_on = np.ones(len(word), bool)
            goes_on[known[hit]] = False
            context, word, open_ = context[goes_on], word[goes_on], open_[goes_on]
        out[open_] += self.root[word]
        return out

    def above_root(self, symbols: np.ndarray) -> np.ndarray:
        """For each place, log10 of P(symbol | longest retained state before it) by P(symbol | root)."""
        out = np.zeros(len(symbols))
        levels = list(self.grams(symbols, max(self.retained, default=0) + 1)) if self.retained else []
        open_ = np.ones(len(symbols), bool)
        open_[0] = False
        for k in range(len(levels) - 1, 0, -1):
            context = np.concatenate([[-1], levels[k - 1][:-1]])
            known = open_ & (context >= 0)
            known[known] = self.retained[k][context[known]]
            gram = levels[k]
            hit = known & (gram >= 0)
            out[hit] += self.log_p[k + 1][gram[hit]] - self.root[symbols[hit]]
            open_ &= ~hit
            rest = known & ~hit
            out[rest] += self.left[k][context[rest]]
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    i = docs[id_col].cast("long")
    return docs.select(i.alias("doc_id"), held_out(i).alias("held_out"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n: how often each word, and the end, stands in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("suffixtree")
        held: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
            held[END.encode()] += batch.num_rows
            if len(held) >= HELD // 8:
                yield out()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _gram_counts(texts: DataFrame, shared, level: int) -> DataFrame:
    """gram, n of the candidates of level + 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("suffixtree")
        tree, held = shared.value, []

        def out():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            held.append(tree.candidates([words_of(t) for t in batch.column(0).to_pylist()], level))
            if sum(map(len, held)) >= HELD:
                yield out()
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Tree, DataFrame]:
    """The tree, and the table of all words and their counts (word, n), from the rows that are not held out.

    Whole texts are read; null texts are empty, and an empty one still has an end. Without rows to learn from the tree is
    its root alone, and the table empty. The driver gets the frequent words and grams, 1 / P_MIN a level at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, id_col, text_col).filter(~F.col("held_out"))
    words = written(_word_counts(texts), "words")
    n, v = words.agg(F.sum("n"), F.count("n")).first()
    least = max(MIN_COUNT, math.ceil(P_MIN * (n or 0)))
    frequent = words.filter(F.col("n") >= least).toArrow()
    got = sorted(zip(frequent["n"].to_pylist(), frequent["word"].cast(pa.binary()).to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    tree = Tree([w for _, w in got], np.array([c for c, _ in got], np.int64), n or 0, v)
    counts = tree.counts
    for level in range(1, DEPTH + 1):
        shared = spark.sparkContext.broadcast(tree)
        found = _gram_counts(texts, shared, level).filter(F.col("n") >= least).toArrow()
        keys, n_keys = found["gram"].to_numpy(), found["n"].to_numpy()
        shared.unpersist()
        order = np.argsort(keys)
        tree.grow(level, keys[order], n_keys[order], counts)
        counts = n_keys[order]
        if not len(keys):
            break
    return tree, words


def score(docs: DataFrame, tree: Tree, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, of its whole text.

    base_score is the log10 probability by single words, score that of the tree. Null texts count as empty: one token, the
    end. Repeated and null ids are kept, other columns left out; an empty table gives an empty one. Words that are not
    frequent are joined to the table of all words, once for each document and word.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("suffixtree")
        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [words_of(x) for x in batch.column(3).to_pylist()]
            symbols, starts = t.symbols(texts)
            known = symbols >= 0
            base = np.where(known, t.root[symbols], 0.0) if len(t.root) else np.zeros(len(symbols))
            base[starts] = 0.0
            known[starts] = False
            gained = t.above_root(symbols)
            gained[starts] = 0.0
            gained[np.append(starts[1:], len(symbols)) - 1] = 0.0
            rare = [Counter(w for w in words if w not in t.ids) for words in texts]
            if END.encode() not in t.ids:
                for c in rare:
                    c[END.encode()] += 1
            cols = [
                *batch.columns[:3], pa.array([len(x) + 1 for x in texts], pa.int64()), pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(gained, starts)),
                pa.array([list(c) for c in rare], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "gained", "rare", "times"])

    texts = _texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = written(texts.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, gained double, rare array<string>, times array<long>"), "scored")
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    space = tree.tokens + ADDED * (tree.vocabulary + 1)
    count = F.coalesce(F.col("n"), F.lit(0))
    sums = each.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((count + ADDED) / space)).alias("rare_base"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    base = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    out = scored.drop("rare", "times").join(sums, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(tree.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gained")).alias("score"))
