"""A cache that serves nothing without a live check: hits, misses, expiries and reads that could not be verified.

Operations on a cache are rows, in order (seq) for each source item (native_id): put, read, and change, which the
source's feed sends and which drops all entries of the item, whatever their kind or version. A read brings what a live check saw:
the item's latest history id, the oldest id that the source still holds, and whether the walk came to its end. Entries live
for a time that goes by kind; any put or read sweeps the item's expired ones.

replay() tells every read of a table by windows; served() is the same as keyed state on a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
# Microseconds that an entry of a kind lives.
TTL = {"vector": 168 * HOUR, "metadata": 24 * HOUR, "structure": 24 * HOUR, "observed_edge": 24 * HOUR, "entity_candidate": 12 * HOUR, "negative": HOUR // 12}
SHORTEST = min(TTL.values())

OUT = "native_id long, seq long, kind string, outcome string, reason string, rebaseline boolean, revision long"


def _lives(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in TTL.items()), F.lit(SHORTEST))


def _checked(revision: Column) -> Column:
    """Why a live check does not let an entry be served, or null: a change that was seen is conclusive whatever else the walk missed."""
    return (
        F.when(F.coalesce(F.col("seen") > revision, F.lit(False)), "changed")
        .when(F.coalesce(F.col("oldest") > revision + 1, F.lit(False)), "watermark_expired")
        .when(~F.coalesce(F.col("complete"), F.lit(False)), "inconclusive")
    )


def _told(outcome: Column, reason: Column, revision: Column) -> list[Column]:
    return [outcome.alias("outcome"), reason.alias("reason"), (reason == "watermark_expired").alias("rebaseline"), F.when(outcome == "hit", revision).alias("revision")]


def replay(ops: DataFrame) -> DataFrame:
    """native_id, seq, kind, outcome (hit, miss, expired, unverified), reason, rebaseline, revision (of what is served) of each read.

    ops: native_id, seq (unique in an item), op, kind, at_us (does not fall with seq), revision (of a put), seen, oldest, complete (of a
    read). An entry of unknown kind lives as long as the shortest-lived. Rows without an item belong to one of their own.
    """
    item, kind = W.partitionBy("native_id").orderBy("seq"), W.partitionBy("native_id", "kind").orderBy("seq")
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    x = ops.withColumn("kind", F.coalesce("kind", F.lit("")))
    x = x.withColumn("_put", F.last(F.when(F.col("op") == "put", F.struct("seq", "at_us", "revision")), True).over(ahead(kind)))
    x = x.withColumn("_changed", F.last(F.when(F.col("op") == "change", F.col("seq")), True).over(ahead(item)))
    x = x.withColumn("_swept", F.last(F.when(F.col("op").isin("put", "read"), F.struct("seq", "at_us")), True).over(ahead(item)))
    over = lambda at: at - F.col("_put.at_us") >= _lives(F.col("kind"))
    gone = (F.col("_changed") > F.col("_put.seq")) | ((F.col("_swept.seq") > F.col("_put.seq")) & over(F.col("_swept.at_us")))
    state = F.when(F.col("_put").isNull() | F.coalesce(gone, F.lit(False)), "miss").when(over(F.col("at_us")), "expired")
    why = _checked(F.col("_put.revision"))
    outcome = F.coalesce(state, F.when(why.isNotNull(), "unverified").otherwise("hit"))
    reason = F.when(state.isNotNull(), "unstated").otherwise(F.coalesce(why, F.lit("unchanged")))
    return x.filter("op = 'read'").select("native_id", "seq", "kind", *_told(outcome, reason, F.col("_put.revision")))


class _Cache(StatefulProcessor):
    """The entries of one item, by kind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "kind string", "at_us long, revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows come in no order within a batch, so those of one item are put in order here.
        ops = pd.concat(list(rows)).sort_values("seq")
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}
        was, out = dict(held), []
        stale = lambda k, at: at - held[k][0] >= TTL.get(k, SHORTEST)
        for r in ops.itertuples(index=False):
            if r.op == "change":
                held.clear()
                continue
            if r.op == "read":
                out.append((r.native_id, r.seq, r.kind, *self.read(r, held, stale)))
            for k in [k for k in held if stale(k, r.at_us)]:
                del held[k]
            if r.op == "put":
                held[r.kind] = (int(r.at_us), None if pd.isna(r.revision) else int(r.revision))
        for k in was.keys() - held.keys():
            self.entries.removeKey((k,))
        for k, v in held.items():
            if was.get(k) != v:
                self.entries.updateValue((k,), v)
        frame = pd.DataFrame(out, columns=["native_id", "seq", "kind", "outcome", "reason", "rebaseline", "revision"])
        yield frame.astype({"revision": "Int64"})

    @staticmethod
    def read(r, held: dict, stale) -> tuple:
        if r.kind not in held:
            return "miss", "unstated", False, None
        if stale(r.kind, r.at_us):
            return "expired", "unstated", False, None
        revision = held[r.kind][1]
        above = lambda x, y: not pd.isna(x) and y is not None and x > y
        if above(r.seen, revision):
            return "unverified", "changed", False, None
        if above(r.oldest, None if revision is None else revision + 1):
            return "unverified", "watermark_expired", True, None
        if pd.isna(r.complete) or not r.complete:
            return "unverified", "inconclusive", False, None
        return "hit", "unchanged", False, revision

    def close(self) -> None:
        pass


def served(ops: DataFrame) -> DataFrame:
    """replay() on a stream. Needs the RocksDB state store, which keeps an entry for each kind of an item; the operations on one item in one
    micro-batch are put in order by one task, so the source's limits on a batch bound them."""
    rows = ops.select(F.col("native_id").cast("long"), "seq", "op", F.coalesce("kind", F.lit("")).alias("kind"), "at_us", "revision", "seen", "oldest", "complete")
    return rows.groupBy("native_id").transformWithStateInPandas(_Cache(), OUT, "Append", "None")


def invalidated(ops: DataFrame) -> DataFrame:
    """native_id, seq, entries: how many entries each change dropped, of those that no sweep had taken before."""
    changes = ops.filter("op = 'change'").select("native_id", "seq", "at_us")
    kinds = ops.filter("op = 'put'").select("native_id", "kind").distinct()
    # A change asks for each kind what a read at its time would have found, live check aside.
    asked = changes.join(kinds, "native_id").select("native_id", "seq", F.lit("ask").alias("op"), "kind", "at_us")
    x = ops.select("native_id", "seq", "op", "kind", "at_us").unionByName(asked)
    item, kind = W.partitionBy("native_id").orderBy("seq").rangeBetween(W.unboundedPreceding, -1), W.partitionBy("native_id", "kind").orderBy("seq").rangeBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_put", F.last(F.when(F.col("op") == "put", F.struct("seq", "at_us")), True).over(kind))
    x = x.withColumn("_changed", F.last(F.when(F.col("op") == "change", F.col("seq")), True).over(item)).withColumn("_swept", F.last(F.when(F.col("op").isin("put", "read"), F.struct("seq", "at_us")), True).over(item))
    gone = (F.col("_changed") > F.col("_put.seq")) | ((F.col("_swept.seq") > F.col("_put.seq")) & (F.col("_swept.at_us") - F.col("_put.at_us") >= _lives(F.col("kind"))))
    dropped = x.filter("op = 'ask'").filter(F.col("_put").isNotNull() & ~F.coalesce(gone, F.lit(False))).groupBy("native_id", "seq").agg(F.count(F.lit(1)).alias("entries"))
    return changes.select("native_id", "seq").join(dropped, ["native_id", "seq"], "left").select("native_id", "seq", F.coalesce("entries", F.lit(0)).alias("entries"))
