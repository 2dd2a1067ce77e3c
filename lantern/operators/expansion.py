"""Structural expansion: the parents that a thread's replies name and nobody has shown, looked up by id; and what a semantic pool draws on.

A query may make MAX_LOOKUPS lookups in all. A parent that one message answers to is recovered and may itself name a parent, which the
next round looks up as long as the query has lookups left; one that several answer to is ambiguous, and none is taken.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import cut

# Lookups of a query, characters of an id that can be asked for, days that a pool reaches back.
MAX_LOOKUPS, MAX_ID, POOL_DAYS = 4, 256, 90


def probeable(header: Column) -> Column:
    """A whole message id, short, without what would change the query it is put into."""
    return F.coalesce((F.char_length(header) <= MAX_ID) & header.rlike(r"^<[^<>\s]+>$") & ~header.rlike(r'["{}()]'), F.lit(False))


def planned(unresolved: DataFrame, used: DataFrame | None = None, cap: int = MAX_LOOKUPS) -> DataFrame:
    """query_id, header, for_child_id, place, state of each distinct header that a query's messages name: probe, over_cap, or skipped (never askable).

    unresolved: query_id, child_id, header, place (its order; the first child that names a header speaks for it). used: query_id, n, lookups
    already made. Null headers name nothing.
    """
    first = unresolved.filter("header is not null").groupBy("query_id", "header").agg(F.min(F.struct("place", "child_id")).alias("x")).select("query_id", "header", F.col("x.child_id").alias("for_child_id"), F.col("x.place").alias("place"))
    ask = probeable(F.col("header"))
    some = first.withColumn("_ask", ask)
    nth = some.filter("_ask").withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy("place", "header"))).filter(F.col("_n") <= cap).select("query_id", "header", "_n")
    x = some.join(nth, ["query_id", "header"], "left")
    spent = F.lit(0)
    if used is not None:
        x, spent = x.join(used.select("query_id", F.col("n").alias("_used")), "query_id", "left"), F.coalesce("_used", F.lit(0))
    state = F.when(~F.col("_ask"), "skipped").when(F.coalesce(F.col("_n") + spent <= cap, F.lit(False)), "probe").otherwise("over_cap")
    return x.select("query_id", "header", "for_child_id", "place", state.alias("state"))


def looked_up(plan: DataFrame, messages: DataFrame) -> DataFrame:
    """plan with state recovered, ambiguous or absent in place of probe, and message_id, thread_id of what was recovered.

    messages: message_id, thread_id, rfc822_message_id. Only headers that one message carries are joined to it, so an id that many share costs a count.
    """
    asked = plan.filter("state = 'probe'").select("header").distinct()
    carried = messages.select("message_id", "thread_id", F.col("rfc822_message_id").alias("header")).join(asked, "header", "left_semi")
    one = carried.groupBy("header").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("message_id", "thread_id")).alias("_m"))
    x = plan.join(one, "header", "left")
    found = F.when(F.col("_n") == 1, "recovered").when(F.col("_n") > 1, "ambiguous").otherwise("absent")
    state = F.when(F.col("state") == "probe", found).otherwise(F.col("state"))
    take = state == "recovered"
    return x.select("query_id", "header", "for_child_id", "place", state.alias("state"), F.when(take, F.col("_m.message_id")).alias("message_id"), F.when(take, F.col("_m.thread_id")).alias("thread_id"))


def expanded(unresolved: DataFrame, messages: DataFrame, rounds: int = 1, cap: int = MAX_LOOKUPS) -> DataFrame:
    """looked_up() rows with round: each round asks for the parents that the last one's messages name and that no earlier round asked for.

    messages carries parent_header as well. A query stops when its lookups are used up or nothing new is named.
    """
    done, asked, used, now = [], None, None, unresolved
    for k in range(1, rounds + 1):
        if asked is not None:
            now = now.join(asked, ["query_id", "header"], "left_anti")
        step = cut(looked_up(planned(now, used, cap), messages).withColumn("round", F.lit(k)))
        if step.isEmpty():
            break
        done.append(step)
        so_far = reduce(DataFrame.unionByName, done)
        asked = so_far.select("query_id", "header").distinct()
        used = so_far.filter("state in ('recovered', 'ambiguous', 'absent')").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        parents = messages.select("message_id", F.col("parent_header").alias("header")).filter("header is not null")
        now = step.filter("state = 'recovered'").select("query_id", "message_id", "place").join(parents, "message_id").select("query_id", F.col("message_id").alias("child_id"), "header", "place")
    return reduce(DataFrame.unionByName, done) if done else looked_up(planned(unresolved), messages).withColumn("round", F.lit(1))


def pool_scope(touched: DataFrame, people: DataFrame, messages: DataFrame, windows: DataFrame) -> DataFrame:
    """query_id, thread_id, priority, basis of the threads a pool draws on: touched by the ladder (0), of people that were asked for (1), in the window (2).

    touched, people: query_id, thread_id. windows: query_id, start_us, end_us (null: POOL_DAYS back from now_us, which it also has). A thread counts for the
    first reason it has. Windows are met by day, so a message is compared with the queries of its day alone.
    """
    day = 86_400_000_000
    start = F.coalesce("start_us", F.col("now_us") - POOL_DAYS * day)
    end = F.coalesce("end_us", F.col("now_us"))
    w = windows.select("query_id", start.alias("_a"), end.alias("_b")).filter("_b > _a")
    w = w.withColumn("_day", F.explode(F.sequence(F.floor(F.col("_a") / day), F.floor((F.col("_b") - 1) / day))))
    m = messages.select("thread_id", "ts_us").filter("ts_us is not null").withColumn("_day", F.floor(F.col("ts_us") / day))
    recent = m.join(w, "_day").filter((F.col("ts_us") >= F.col("_a")) & (F.col("ts_us") < F.col("_b"))).select("query_id", "thread_id").distinct()
    parts = [(touched, 0, "touched"), (people, 1, "participant"), (recent, 2, "recency")]
    rows = reduce(DataFrame.unionByName, [df.select("query_id", "thread_id", F.struct(F.lit(k).alias("priority"), F.lit(b).alias("basis")).alias("x")) for df, k, b in parts])
    return rows.groupBy("query_id", "thread_id").agg(F.min("x").alias("x")).select("query_id", "thread_id", "x.priority", "x.basis")
