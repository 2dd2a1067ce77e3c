"""The audits of filters and of sources, and the language model, against brute force and odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lantern.llm import divergence, filters, suffixtree

DOC = "doc_id long, text string, lang string, source string, part string, first int, n string"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts on both sides of each filter's limit, copies, repeated rows, nulls in every column, and columns of clashing names."""
    rng, rows = random.Random(5), []
    for i in range(260):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "été", "x$y", "don", f"w{i}"]) + ("" if rng.random() < 0.5 else str(rng.randrange(60))) for _ in range(rng.choice([0, 3, 49, 50, 51, 80]))]
        if rng.random() < 0.5:
            words = [w.replace("$", "").lower() for w in words]
        rows.append((i, rng.choice([" ", "\n\x0b ", "\x1c"]).join(words), rng.choice(["en", "de", None, ""]), rng.choice(["src0", "src1", None, ""])))
    rows += [(500 + i, rows[3][1], "en", f"src{i % 2}") for i in range(40)] + [rows[3], rows[3], (None, rows[3][1], "en", "src0"), (None, None, None, None), (600, None, "en", "only"), (601, "", "xx", "empty"), (602, "long wörds " * 40_000, "en", "src0")]
    return spark.createDataFrame([(*r, "p", 1, "n") for r in rows], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 520, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _filters_by_hand(rows, labels):
    least, docs = {}, []
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    good, toxic = ({x.doc_id for x in labels if x.doc_id is not None and x[k] == 1} for k in ("quality", "toxic"))
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": r.doc_id is not None and r.doc_id > least[t]}
        docs.append((r.source or "", {k for k in "ABCDE" if fails[k]}, r.doc_id in good, r.doc_id in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [d for d in left if k in d[1]]
                left = [d for d in left if k not in d[1]]
                shapley[k] += len(gone)
                redundant = sum(k in d[1] and bool(d[1] & set(order[: step - 1])) for d in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[1] == {k} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_filters(docs, labels):
    failed = filters.failures(docs)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filters.audit(failed, labels).collect()}
    assert got == _filters_by_hand(docs.collect(), labels.collect())
    assert failed.count() == docs.count() and filters.audit(filters.failures(docs.limit(0)), labels).count() == 0
    assert {r.good_lost for r in filters.audit(failed, labels.limit(0)).collect()} == {0}


def test_filter_limits():
    words = [f"w{i}" for i in range(50)]
    assert filters.flags(" ".join(words).encode()) == (0, 0, 0, 0) and filters.flags(" ".join(words[1:]).encode())[0] == 1
    assert filters.flags(b"a a a a a a a b c d e f g h i j k l m n")[1] == 0 and filters.flags(b"a a b")[1] == 0 and filters.flags(b"a a a b")[1] == 1
    assert filters.flags(("A" + "é" * 19).encode())[2] == 0 and filters.flags(("A" + "é" * 18).encode())[2] == 1
    assert filters.flags(b"") == (1, 0, 0, 0) and all(filters.flags(c.encode())[3] for c in "#$%&*|")


class TreeByHand:
    """The same tree from dictionaries of tuples, one context and word at a time."""

    def __init__(self, texts):
        self.seqs = [["", *t, ""] for t in texts]
        self.uni = Counter(w for s in self.seqs for w in s[1:])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        grams = {k: Counter(tuple(s[i : i + k]) for s in self.seqs for i in range(len(s) - k + 1)) for k in range(2, suffixtree.DEPTH + 2)}
        self.nexts = defaultdict(dict)
        for k in grams:
            for g, c in grams[k].items():
                if c >= suffixtree.MIN_COUNT:
                    self.nexts[g[:-1]][g[-1]] = c
        self.counts = {g: c for k in grams for g, c in grams[k].items()} | {(w,): c for w, c in self.uni.items()}
        self.states = {}
        for s in sorted(self.nexts, key=len):
            p = {w: (c - suffixtree.DISCOUNT) / self.counts[s] for w, c in self.nexts[s].items()}
            below = {w: self.p(s[1:], w) for w in p}
            left = (1 - sum(p.values())) / (1 - sum(below.values()))
            gain = sum(p[w] * math.log(p[w] / below[w]) for w in p) + (1 - sum(p.values())) * math.log(left)
            if 2 * self.counts[s] * gain > len(p) * math.log(self.n):
                self.states[s] = (p, left)

    def p(self, s, w):
        s = tuple(s[-suffixtree.DEPTH :]) if s else ()
        while s and s not in self.states:
            s = s[1:]
        if not s:
            return (self.uni.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        p, left = self.states[s]
        return p[w] if w in p else left * self.p(s[1:], w)


def test_suffix_tree(spark, docs):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    line = "one two three four five six seven eight"
    more = spark.createDataFrame([(1000 + i, f"{line} {i} {line if i % 3 else ''}", "en", "s", "p", 1, "n") for i in range(60)], DOC)
    rows = docs.filter("doc_id is null or doc_id <> 602").unionByName(more)
    out = lambda r: r is not None and zlib.crc32(str(r).encode()) % 10 == 0
    all_rows = rows.collect()
    hand = TreeByHand([cut(r.text) for r in all_rows if not out(r.doc_id)])
    want = []
    for r in all_rows:
        s = ["", *cut(r.text), ""]
        base, full = sum(math.log10(hand.p((), w)) for w in s[1:]), sum(math.log10(hand.p(s[:i], s[i])) for i in range(1, len(s)))
        want.append((r.doc_id, out(r.doc_id), len(s) - 1, sum(hand.uni.get(w, 0) > 0 for w in s[1:]), hand.n, round(base, 6), round(full, 6)))
    tree, words = suffixtree.train(rows)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in suffixtree.score(rows, tree, words).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {len(s) for s in hand.states} >= {1, 2} and sum(map(sum, tree.retained.values())) == len(hand.states)
    # Every state's distribution sums to one: over all words, and one that is unseen.
    for s in [(), *list(hand.states)[:40]]:
        assert abs(sum(hand.p(s, w) for w in [*hand.uni, "unseen!"]) - 1) < 1e-9
    assert suffixtree.score(rows.limit(0), tree, words).count() == 0
    nothing = suffixtree.train(rows.limit(0))
    assert {(r.train_tokens, r.n_known, r.score) for r in suffixtree.score(rows.limit(5), *nothing).collect()} == {(0, 0, 0.0)}


def test_suffix_tree_long_text(spark):
    text = "alpha beta gamma " * 60_000
    rows = spark.createDataFrame([(1, text), (2, "alpha beta gamma"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.score(rows, *suffixtree.train(rows)).collect()}
    assert got[1].n_tokens == 180_001 and got[3].n_tokens == 1 and 0 > got[1].score > got[1].base_score / 100


def _divergence_by_hand(rows):
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    count, df, groups = defaultdict(Counter), defaultdict(Counter), sorted({(r.lang or "", r.source or "") for r in rows})
    for r in rows:
        terms = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]
        count[r.lang or "", r.source or ""].update(terms)
        df[r.lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        of = {s: {t: count[lang, s][t] for t in kept} for x, s in groups if x == lang}
        of[None] = {t: sum(of[s][t] for s in of) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (n + 1) // (sum(of[s].values()) + len(kept)) for t, n in of[s].items()} for s in of}
        far = lambda a, b: (a - b) ** 2 // b
        for s in of:
            if s is not None:
                pairs = [(b, sum(far(p[s][t], p[b][t]) for t in kept)) for b in of if b not in (s, None)]
                terms = [(t, far(p[s][t], p[None][t])) for t in kept if of[s][t] and p[s][t] > p[None][t]]
                for part, items, most in (("pair", pairs, None), ("term", terms, divergence.TOP)):
                    ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                    out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(docs, spark, monkeypatch, small):
    if small:  # runs over many batches, pairs in pieces, groups joined
        for name, n in (("ROWS", 7), ("PAIRS", 5), ("HELD", 50), ("BROADCAST_GROUPS", 0)):
            monkeypatch.setattr(divergence, name, n)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("été", "Straße", "zoo", "x", "It's") for b in "abcdefghijkl"]
    more = [(2000 + i, " ".join(rng.choices(words, k=rng.randrange(1, 30))), rng.choice(["en", "de"]), f"s{rng.randrange(9)}", "p", 1, "n") for i in range(80)]
    rows = docs.unionByName(spark.createDataFrame(more, DOC))
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.audit(rows).collect()]
    assert sorted(got) == sorted(_divergence_by_hand(rows.collect()))
    assert divergence.audit(rows.limit(0)).count() == 0
