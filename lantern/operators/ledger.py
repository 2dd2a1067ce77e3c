"""Accounting: every retrieved id is either disclosed or withheld with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(routes: DataFrame) -> DataFrame:
    """message_id with its first route (by seq): first admission wins."""
    cols = [c for c in routes.columns if c not in ("message_id", "seq")]
    return routes.groupBy("message_id").agg(F.min(F.struct("seq", *cols)).alias("r")).select("message_id", "r.*")


def withheld(hits: DataFrame, disclosed: DataFrame) -> DataFrame:
    return hits.select("message_id").distinct().join(disclosed.select("message_id"), "message_id", "left_anti")


def certify(hits: DataFrame, disclosed: DataFrame, held: DataFrame) -> None:
    """Raises unless hits are the disjoint union of disclosed and withheld ids."""
    h, d, w = (x.select("message_id").distinct().withColumn(n, F.lit(1)) for x, n in ((hits, "h"), (disclosed, "d"), (held, "w")))
    j = h.join(d, "message_id", "full").join(w, "message_id", "full")
    bad = j.agg(F.sum(F.expr("int(h is null)")).alias("alien"), F.sum(F.expr("int(h = 1 and d is null and w is null)")).alias("unexplained"), F.sum(F.expr("int(d = 1 and w = 1)")).alias("both")).first()
    if any(bad):
        raise ValueError(f"the account does not close: {bad.asDict()}")


def pool_only(routes: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Ids that only pool probes listed, less the shortlist."""
    only = routes.groupBy("message_id").agg(F.min((F.col("rung") == "L5").cast("int")).alias("x")).filter("x = 1").select("message_id")
    return only.join(shortlist.select("message_id"), "message_id", "left_anti")


def digest(ids: DataFrame) -> DataFrame:
    """SHA-256 over the sorted distinct ids: hashes of blocks first, then of the blocks, so no task holds all ids."""
    b = ids.select("message_id").distinct().groupBy(F.substring(F.md5("message_id"), 1, 3).alias("block")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("message_id")), "\n"), 256).alias("h"))
    return b.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n"), 256).alias("digest"))


def groups(held: DataFrame, named: int = 24) -> DataFrame:
    """The `named` largest (thread, cap) groups by rank, the rest in one tail for each cap."""
    g = held.groupBy("thread_id", "cap").agg(F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.desc("n"), "thread_id", "cap").limit(named).select("thread_id", "cap", F.lit(True).alias("named"))
    j = g.join(top, ["thread_id", "cap"], "left")
    tail = j.filter("named is null").groupBy("cap").agg(F.lit(None).cast("bigint").alias("thread_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    return j.filter("named").select("thread_id", "cap", "n", F.lit(1).cast("long").alias("groups")).unionByName(tail)
