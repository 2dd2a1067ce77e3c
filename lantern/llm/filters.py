"""Filter interaction audit: what five filters remove together, alone and in any order, by inclusion and exclusion.

The corpus is read once, for five flags a document. One aggregation counts, for each part and each of the 32 sets of
filters, the documents that fail all filters of the set: sums of products of flags. All else follows from these joint
counts by Möbius inversion, in a table of 405 signed terms: after filters P, filter i removes the sum over subsets S of P
of (-1)^|S| times the joint count of S and i. The joint counts, signed, are Harsanyi dividends of the game "documents
removed by a set", so each filter's Shapley value is the sum of its sets' dividends, shared equally within a set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import small_batches, written

FILTERS = "ABCDE"
#: Limits of the filters: words, distinct words and capitals in hundredths, the signs that no text may hold.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SIGNS = 50, 65, 5, b"#$%&*|"
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))
#: All orders count once, so a dividend shared by k filters gives each this often a k-th part.
ORDERS = 120


def _sets(of: str) -> list[str]:
    return ["".join(c) for c in chain.from_iterable(combinations(of, k) for k in range(len(of) + 1))]


SETS = _sets(FILTERS)


def flags(text: bytes) -> tuple[int, int, int, int]:
    """Filters A to D of a text in UTF-8, 1 for a failure; bytes.split() parts words at the six signs of white space of ASCII."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return int(len(words) < MIN_WORDS), int(100 * len(set(words)) < MIN_DISTINCT * len(words)), int(100 * capitals > MAX_CAPITALS * points), int(signs)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, A, B, C, D, E (0 or 1) for every row.

    Null texts and sources count as empty. E: a row of smaller doc_id has the same text, by SHA-256; rows that repeat
    an id and a text are no copies of each other, and a null id is neither smaller nor larger than any, so such rows pass
    E. Whole texts are read, and none is shuffled: a digest stands for it. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found = np.array([flags(t) for t in texts], np.int32).reshape(-1, 4)
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests, *map(pa.array, found.T.copy())], names=["doc_id", "part", "digest", *FILTERS[:4]])

    text = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = written(narrow.mapInArrow(run, "doc_id long, part string, digest binary, A int, B int, C int, D int"), "flags")
    # The least id of a text comes from partial sums; it is joined by text and id, so that no group of copies is one key.
    first = narrow.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    out = narrow.join(first, ["digest", "doc_id"], "left")
    copy = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("first", F.lit(1)))
    return out.select("doc_id", "part", *FILTERS[:4], copy.alias("E"))


def _labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """failed with good and toxic (0 or 1): whether any label of the id says so. Rows of null ids are spread, as they meet none."""
    one = lambda c: F.max(F.coalesce(labels[c].cast("int") == 1, F.lit(False)).cast("int"))
    known = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    spread = F.when(F.col("doc_id").isNotNull(), 0).otherwise((F.rand(7) * 1024).cast("int"))
    out = failed.withColumn("spread", spread).join(known, ["doc_id", "spread"], "left")
    return out.select("part", *FILTERS, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def joint(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, members, n, good, toxic: for each part and set of filters, the documents that fail all filters of the set."""

    def product(members: str) -> Column:
        return reduce(lambda x, k: x * F.col(k), members, F.lit(1)).cast("long")

    weights = ("n", "good", "toxic")
    # Products of flags are the same for all documents of one pattern, so patterns are counted first: 32 a part.
    patterns = _labelled(failed, labels).groupBy("part", *FILTERS).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("members"), product(s).alias("fails")) for s in SETS]))
    rows = patterns.select("part", *weights, each.alias("x"))
    return rows.groupBy("part", F.col("x.members").alias("members")).agg(*[F.sum(F.col("x.fails") * F.col(w)).alias(w) for w in weights])


def _terms() -> list[tuple[str, str, str, int]]:
    """(filter, the filters before it, members, sign) of removals: 405 rows."""
    sort = lambda s: "".join(sorted(s))
    return [(i, before, sort(s + i), (-1) ** len(s)) for i in FILTERS for before in _sets(FILTERS.replace(i, "")) for s in _sets(before)]


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, zeros included; the columns are long but part, filter_order, step.

    failed is what failures() gives. kept and removed: documents after and in this step. redundant: they fail its filter
    but were removed before. unique_fails: they fail no other filter. good_lost, toxic_lost: removed here, labelled quality 1
    or toxic 1; of several labels of an id any counts, null labels do not. shapley: its filter's removals over all 120 orders.
    """
    spark = failed.sparkSession
    counts = written(joint(failed, labels), "joint")  # 32 rows a part
    # Fixed tables of 405, 80, 242 and 600 rows, whatever the input.
    terms = F.broadcast(spark.createDataFrame(_terms(), "filter string, before string, members string, sign long"))
    signed = [F.sum(F.col("sign") * F.col(c)).alias(to) for c, to in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    removals = counts.join(terms, "members").groupBy("part", "filter", "before").agg(*signed)
    dividends = [(i, s, (-1) ** (len(s) + 1) * ORDERS // len(s)) for s in SETS for i in s]
    shares = F.broadcast(spark.createDataFrame(dividends, "filter string, members string, share long"))
    alone = [F.sum(F.col("share") * F.col("n")).alias("shapley"), F.max(F.when(F.col("members") == F.col("filter"), F.col("n"))).alias("fails")]
    of_filter = counts.join(shares, "members").groupBy("part", "filter").agg(*alone)
    others = F.length("before") == len(FILTERS) - 1
    unique = removals.filter(others).select("part", "filter", F.col("removed").alias("unique_fails"))
    steps = [("".join(o), k + 1, o[k], "".join(sorted(o[:k])), "".join(sorted(o[: k + 1]))) for o in permutations(FILTERS) for k in range(len(FILTERS))]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before string, upto string"))
    # What a set of filters leaves, by the same inversion, is the total with each member's intersections taken off in turn.
    left = [(u, s, (-1) ** len(s)) for u in SETS if u for s in _sets(u)]
    leaves = F.broadcast(spark.createDataFrame(left, "upto string, members string, sign long"))
    kept = counts.join(leaves, "members").groupBy("part", "upto").agg(F.sum(F.col("sign") * F.col("n")).alias("kept"))
    each = removals.join(of_filter, ["part", "filter"]).join(unique, ["part", "filter"])
    out = each.join(orders, ["filter", "before"]).join(kept, ["part", "upto"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
