"""Greedy pages of views of any length: starts by pointer jumping, no view in one task.

A page takes rows in order until the next would not fit; a row that is larger than a page is named on a page of its own, and the
next page starts behind it. Where a page starts depends on where the one before it ended, so each row gets a pointer to
the start that would follow if it were one: with costs summed up along the view, the row that holds the point one page further.
Chunks of bounded length follow the pointers of their rows to the point where they leave the chunk; a page never skips a
chunk, so only rows within a page's length of a chunk's start can be entered. Their pointers, from chunk to chunk, are
doubled until the entry of every chunk is known, and then each chunk tells its pages by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import cut

# Fixed value: characters of a page.
PAGE_CHARS = 16_000
#: Rows of a chunk; more where a page may hold more, since each row costs 1 at least.
CHUNK = 16_384


def placed(rows: DataFrame, view: str, order: str, cost: str) -> DataFrame:
    """rows with _rank and _before, the rows and the cost ahead of each in its view: running sums over ranges of (view, order)."""
    c = F.greatest(F.coalesce(F.col(cost).cast("long"), F.lit(1)), F.lit(1))
    ranged = cut(rows.withColumn("_cost", c).repartitionByRange(view, order).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy(view, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = ranged.groupBy(view, "_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("_cost").alias("_sum"))
    ahead = W.partitionBy(view).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col(view).alias("_v"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_s0"))
    out = ranged.withColumn("_i", F.count(F.lit(1)).over(inside) - 1).withColumn("_s", F.sum("_cost").over(inside) - F.col("_cost"))
    out = out.join(offsets, F.col(view).eqNullSafe(F.col("_v")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("_rank", F.col("_i") + F.col("_n0")).withColumn("_before", F.col("_s") + F.col("_s0")).drop("_i", "_s", "_n0", "_s0", "_v", "_r", "_range")


def _targets(before: np.ndarray, cost: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The point at which the page after one that starts at each row starts, and the row of the chunk that holds it (past its end: len)."""
    to = before + np.where(cost > limit, cost, limit)
    at = np.searchsorted(before, to, "right") - 1
    return to, np.where(to >= before[-1] + cost[-1], len(before), at)


def _exits(limit: int):
    """Of a chunk, the rows that a page from before it may start at: what they cover, and the point where their pages leave it."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_rank")
        before, cost = t["_before"].to_numpy(), t["_cost"].to_numpy()
        to, at = _targets(before, cost, limit)
        inner = np.append(np.where(at < len(before), at, np.arange(len(before))), len(before))
        while (inner != inner[inner]).any():
            inner = inner[inner]
        few = np.flatnonzero(before < before[0] + limit)
        return pa.table({"_view": t["_view"].take(pa.array(few)), "_chunk": t["_chunk"].take(pa.array(few)), "lo": before[few], "hi": (before + cost)[few], "exit": to[inner[:-1]][few]})

    return run


def _numbered(limit: int):
    """A chunk's rows with the page that each is on, counted from the chunk's first start (0: the page that was open before it)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_rank")
        before, cost = t["_before"].to_numpy(), t["_cost"].to_numpy()
        _, at = _targets(before, cost, limit)
        start = np.zeros(len(before), np.int64)
        i = int(np.searchsorted(before, t["_entry"][0].as_py()))
        while i < len(before):  # pages of one chunk, CHUNK at most
            start[i] = 1
            i = int(at[i])
        page = np.cumsum(start)
        return pa.table({"_view": t["_view"], "_rank": t["_rank"], "_chunk": t["_chunk"], "_local": page, "_large": cost > limit})

    return run


def _entries(chunked: DataFrame, limit: int, kind: str) -> DataFrame:
    """_view, _chunk, _entry: where the first page that starts in a chunk starts, as the cost ahead of it."""
    e = cut(chunked.groupBy("_view", "_chunk").applyInArrow(_exits(limit), f"_view {kind}, _chunk long, lo long, hi long, exit long"))
    # The entered row of the next chunk is the last one that starts at the exit or before it; none, if the view ends before the exit.
    points = e.select("_view", (F.col("_chunk") + 1).alias("_chunk"), F.col("exit").alias("v"), F.lit(1).alias("k"), "lo", F.lit(None).cast("long").alias("hi"))
    starts = e.select("_view", "_chunk", F.col("lo").alias("v"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("lo"), "hi")
    w = W.partitionBy("_view", "_chunk").orderBy("v", "k").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = points.union(starts).withColumn("to", F.last(F.when(F.col("k") == 0, F.struct("v", "hi")), True).over(w)).filter("k = 1 and v < to.hi")
    jump = cut(met.select("_view", (F.col("_chunk") - 1).alias("_chunk"), "lo", F.col("to.v").alias("to")))
    reached = e.filter("_chunk = 0 and lo = 0").select("_view", "_chunk", F.col("lo").alias("_entry"))
    chunks = e.agg(F.max("_chunk")).first()[0] or 0
    for k in range(math.ceil(math.log2(chunks + 1))):
        step = 1 << k
        reach = jump.select(F.col("_view").alias("_v"), F.col("_chunk").alias("_c"), F.col("lo").alias("_l"), F.col("to").alias("further"))
        far = reached.join(reach, F.col("_view").eqNullSafe(F.col("_v")) & (F.col("_chunk") == F.col("_c")) & (F.col("_entry") == F.col("_l")))
        reached = cut(reached.union(far.select("_view", F.col("_chunk") + step, "further")))
        # A jump of twice the length: the one that starts where this one ends, step chunks on.
        again = F.col("_view").eqNullSafe(F.col("_v")) & (F.col("_chunk") + step == F.col("_c")) & (F.col("to") == F.col("_l"))
        jump = cut(jump.join(reach, again).select("_view", "_chunk", "lo", F.col("further").alias("to")))
    return reached


def pages(rows: DataFrame, view: str = "view", order: str = "position", cost: str = "chars", limit: int = PAGE_CHARS, chunk: int = CHUNK) -> DataFrame:
    """rows with page (from 0 in each view), state ('ok' or 'oversized'), total (rows of the view) and index (from 0).

    Rows are in the order of a column that is unique within a view; a cost that is null or below 1 counts as 1. A view may
    be null, which is a view of its own; an empty table gives an empty one. Column names that begin with an underscore are taken.
    """
    chunk = max(chunk, limit)
    kind = dict(rows.dtypes)[view]
    at = placed(rows, view, order, cost)
    at = cut(at.withColumn("_chunk", F.floor(F.col("_rank") / chunk).cast("long")))
    chunked = at.select(F.col(view).alias("_view"), "_chunk", "_rank", "_before", "_cost")
    found = _entries(chunked, limit, kind)
    e = found.select(F.col("_view").alias("_v"), F.col("_chunk").alias("_c"), "_entry")
    told = chunked.join(e, chunked["_view"].eqNullSafe(e["_v"]) & (chunked["_chunk"] == e["_c"]), "left").drop("_v", "_c")
    # A last chunk that no page starts in lies on the page before it.
    told = told.withColumn("_entry", F.coalesce("_entry", F.lit((1 << 63) - 1)))
    told = cut(told.groupBy("_view", "_chunk").applyInArrow(_numbered(limit), f"_view {kind}, _rank long, _chunk long, _local long, _large boolean"))
    sums = told.groupBy("_view", "_chunk").agg(F.max("_local").alias("_pages"), F.count(F.lit(1)).alias("_rows"))
    ahead = W.partitionBy("_view").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("_view").alias("_v"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_pages").over(ahead), F.lit(0)).alias("_p0"), F.sum("_rows").over(W.partitionBy("_view")).alias("total"))
    told = told.join(sums, told["_view"].eqNullSafe(sums["_v"]) & (told["_chunk"] == sums["_c"])).select(F.col("_view").alias("_v"), F.col("_rank").alias("_k"), (F.col("_p0") + F.col("_local") - 1).alias("page"), F.when(F.col("_large"), "oversized").otherwise("ok").alias("state"), "total")
    out = at.join(told, at[view].eqNullSafe(told["_v"]) & (at["_rank"] == told["_k"]))
    return out.select(*rows.columns, "page", "state", "total", F.col("_rank").alias("index"))


def page_table(paged: DataFrame, view: str = "view") -> DataFrame:
    """view, page, state, returned_from, next_cursor (null on the last page), items: the pages that pages() found, as a reader turns them.

    An oversized page gives no items; its row is named by returned_from, and the cursor is past it.
    """
    g = paged.groupBy(view, "page").agg(F.max("state").alias("state"), F.min("index").alias("returned_from"), F.max("index").alias("_last"), F.count(F.lit(1)).alias("_n"), F.max("total").alias("total"))
    following = F.col("_last") + 1
    return g.select(view, "page", "state", "returned_from", F.when(following < F.col("total"), following).alias("next_cursor"), F.when(F.col("state") == "ok", F.col("_n")).otherwise(0).alias("items"))

