"""Source divergence audit: how far each source of a language stands from the others, and by which terms.

Sort-based streaming. Rows (lang, term, source, document) are dealt by language and term and sorted within partitions, so
that a task meets each term's rows as one run, source by source; a scan of run lengths gives document frequencies and
counts, never holding more than the open run. A second scan of the same kind, over the kept terms with their shares, emits
partial pairs of sources and the terms of each source.

Two sources differ on every kept term, also on those that neither has. Summing all that term by term would be sources
squared for each term; instead the sum over a pair splits exactly: what both would give without any count, for all terms,
corrections for the counts of each source against the other without any (grouped by count), and corrections where both
have counts, which only the scan can see.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.llm.common import caches_of, small_batches, written

#: Documents of its language that a kept term is in; the unit of a share; ranks of terms that are reported.
MIN_DOCS, UNIT, TOP = 3, 1_000_000_000, 200
#: All bytes of ASCII but letters part terms; capitals A to Z are lowered.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Terms that a task counts before it passes them on; pairs that a scan holds, and expands at once.
HELD, PAIRS = 400_000, 1 << 20
#: Rows that a scan looks at together, beside those of the open run.
ROWS = 50_000
#: Groups up to this many are broadcast to the kept terms; more are joined.
BROADCAST_GROUPS = 50_000


def _counted(docs: DataFrame) -> DataFrame:
    """lang, term, source, document, df, n: counts of terms by language and source, combined over the documents of a task (document: the first of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("divergence")
        held: dict[tuple, tuple] = {}

        def out():
            for (lang, source), (first, df, n) in held.items():
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                size = len(terms)
                cols = [pa.array([lang] * size, pa.string()), terms, pa.array([source] * size, pa.string()), pa.array([first] * size, pa.int64()), pa.array([df[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())]
                rows = pa.RecordBatch.from_arrays(cols, names=["lang", "term", "source", "document", "df", "n"])
                yield rows.take(pc.sort_indices(rows["term"]))  # neighbours that share letters pack better
            held.clear()

        for batch in batches:
            for doc, lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.translate(TERMS).split()
                _, df, n = held.setdefault((lang, source), (doc, Counter(), Counter()))
                n.update(terms)
                df.update(set(terms))
            if len(held) + sum(len(x[1]) for x in held.values()) >= HELD:
                yield from out()
        yield from out()

    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), empty("lang").alias("lang"), empty("source").alias("source"), F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias("text"))
    return narrow.mapInArrow(run, "lang string, term string, source string, document long, df long, n long")


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a run of equal values in the named columns starts."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in names:
        x = table[c].combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, fold=lambda t: t) -> Iterator[pa.Table]:
    """The batches of a sorted partition cut anew, to tables of about so many rows, so that no run of keys is parted; fold shortens
    what is kept of an open run."""
    held, size = [], 0

    def cut(last: bool) -> Iterator[pa.Table]:
        t = pa.concat_tables(held)
        held.clear()
        at = t.num_rows if last else int(_starts(t, keys)[-1])
        if at:
            yield fold(t.slice(0, at))
        if not last:
            held.append(fold(t.slice(at)))

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= rows:
            yield from cut(False)
            size = 0
    if sum(t.num_rows for t in held):
        yield from cut(True)


def _fold(t: pa.Table) -> pa.Table:
    """One row for each run of (lang, term, source)."""
    at = _starts(t, ["lang", "term", "source"])
    cols = {c: t[c].take(pa.array(at)) for c in ("lang", "term", "source", "document")}
    return pa.table(cols | {c: np.add.reduceat(t[c].to_numpy(), at) for c in ("df", "n")})


def terms(docs: DataFrame) -> DataFrame:
    """lang, term, source, n, lang_n, first: the counts of the kept terms, one row for each source that has one; first is 1 in one row of a term."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("divergence")
        for t in _runs(batches, ["lang", "term"], ROWS, _fold):
            at = _starts(t, ["lang", "term"])
            lengths = np.diff(np.append(at, t.num_rows))
            kept = np.repeat(np.add.reduceat(t["df"].to_numpy(), at) >= MIN_DOCS, lengths)
            total = np.repeat(np.add.reduceat(t["n"].to_numpy(), at), lengths)
            first = np.zeros(t.num_rows, np.int64)
            first[at] = 1
            out = pa.table({"lang": t["lang"], "term": t["term"], "source": t["source"], "n": t["n"], "lang_n": total, "first": first}).filter(pa.array(kept))
            yield from out.combine_chunks().to_batches()

    order = ["lang", "term", "source", "document"]
    rows = _counted(docs).repartition("lang", "term").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "lang string, term string, source string, n long, lang_n long, first long")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", (wide(n) + 1).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + wide(terms)).cast("long"))


# Fixed by the contract: the square of a difference of shares by the second share, rounded down.
def _far(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def _np_far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _scanned(shared: DataFrame) -> DataFrame:
    """lang, source, item, value, part of the rows lang, term, source, p, base, q: for runs of a term, what its counts in two sources at
    once add to the pair (partial sums), and the terms that a source has above its language."""

    def pairs(t: pa.Table) -> Iterator[tuple]:
        """Correction of each ordered pair of rows of a term, PAIRS at a time."""
        at = _starts(t, ["lang", "term"])
        lengths = np.diff(np.append(at, t.num_rows))
        of, size = np.repeat(at, lengths), np.repeat(lengths, lengths)
        p, base = t["p"].to_numpy(), t["base"].to_numpy()
        lang, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        langs, sources, s = lang.dictionary.to_pylist(), source.dictionary.to_pylist(), len(source.dictionary)
        l_at, s_at = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        begin = 0
        while begin < len(size):
            upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            i = np.repeat(np.arange(begin, upto), size[begin:upto])
            j = np.arange(len(i)) - np.repeat(np.cumsum(size[begin:upto]) - size[begin:upto], size[begin:upto]) + of[i]
            i, j = i[i != j], j[i != j]
            v = _np_far(p[i], p[j]) - _np_far(p[i], base[j]) - _np_far(base[i], p[j]) + _np_far(base[i], base[j])
            key, place = np.unique((l_at[i] * s + s_at[i]) * s + s_at[j], return_inverse=True)
            sums = np.zeros(len(key), np.int64)
            np.add.at(sums, place, v)
            for k, x in zip(key.tolist(), sums.tolist(), strict=True):
                yield (langs[k // s // s], sources[k // s % s], sources[k % s]), x
            begin = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches_of("divergence")
        held: dict[tuple[str, str, str], int] = {}

        def rows(part: str, lang, source, item, value) -> pa.RecordBatch:
            cols = [*(pa.array(c, pa.string()) for c in (lang, source, item)), pa.array(value, pa.int64()), pa.array([part] * len(value), pa.string())]
            return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "item", "value", "part"])

        def partial() -> pa.RecordBatch:
            out = rows("pair", *zip(*held, strict=True), list(held.values()))
            held.clear()
            return out

        for t in _runs(batches, ["lang", "term"], ROWS):
            p, q = t["p"].to_numpy(), t["q"].to_numpy()
            above = t.filter(pa.array(p > q)).combine_chunks()
            for b in above.to_batches():
                yield rows("term", b["lang"], b["source"], b["term"], _np_far(b["p"].to_numpy(), b["q"].to_numpy()))
            for pair, v in pairs(t):
                held[pair] = held.get(pair, 0) + v
                if len(held) >= PAIRS:
                    yield partial()
        if held:
            yield partial()

    return shared.mapInArrow(run, "lang string, source string, item string, value long, part string")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language the other sources by distance (part pair), and its TOP terms above the language (part term).

    Null texts, languages and sources count as empty ones; a source without terms has shares of equal size; a language
    without kept terms gives pairs of value 0. Rows that repeat are documents of their own. Texts are read whole;
    other columns and their names do not matter; an empty table gives an empty one. Values are exact: shares of a source
    sum to UNIT and one for each term at most, so sums of squares by a share stay below 2^63 for up to 4 * 10^9 kept terms.
    """
    spark = docs.sparkSession
    kept = written(terms(docs), "terms")
    empty = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    names = docs.select(empty("lang"), empty("source")).distinct()
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = names.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("lang_total"), zero("v"))
    groups = written(groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("v"))), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    shared = kept.join(F.broadcast(groups) if few else groups, ["lang", "source"])
    shared = shared.select("lang", "term", "source", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "base", _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    scanned = written(_scanned(shared.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")), "scanned")

    # The part of a pair that needs no scan: sources of one language against each other, and against the counts of each.
    counted = shared.groupBy("lang", "source", "p", "base").agg(F.count(F.lit(1)).alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"), "v")
    both = lambda left: left.join(other, "lang").filter("source <> item")
    none = both(groups.select("lang", "source", "base")).select("lang", "source", "item", F.coalesce(F.col("v") * _far("base", "other_base"), F.lit(0)).alias("value"))
    one = both(counted)
    mine = F.col("times") * (_far("p", "other_base") - _far("base", "other_base"))
    theirs = F.col("times") * (_far("other_base", "p") - _far("other_base", "base"))
    sides = F.explode(F.array(F.struct("source", "item", mine.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), theirs.alias("value"))))
    one = one.select("lang", sides.alias("x")).select("lang", "x.*")
    cols = ["lang", "source", "item", "value"]
    pairs = none.unionByName(one).unionByName(scanned.filter("part = 'pair'").select(cols)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    top = ranked(scanned.filter("part = 'term'").select(cols), "term").filter(F.col("rank") <= TOP)
    return ranked(pairs, "pair").unionByName(top)
