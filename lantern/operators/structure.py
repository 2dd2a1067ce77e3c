"""Threads: positions, reply links, cycles, participants and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import cut
from lantern.functions.text import ADDRESS, addresses_in_header, message_ids_in

DAY_MS = 86_400_000


def positions(m: DataFrame) -> DataFrame:
    """thread_id, message_id, position (from 0 by date, then id), tied; positions are null in a thread with a date missing."""
    w = W.partitionBy("thread_id")
    dated = F.count("internal_date_ms").over(w) == F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(F.col("internal_date_ms").asc_nulls_first(), "message_id")) - 1
    tied = F.col("internal_date_ms").isNotNull() & (F.count("internal_date_ms").over(W.partitionBy("thread_id", "internal_date_ms")) > 1)
    return m.select("thread_id", "message_id", F.when(dated, at).alias("position"), tied.alias("tied"))


def reply_links(m: DataFrame) -> DataFrame:
    """message_id, thread_id, parent_id, linkage, evidence for each message.

    Candidates are the ids of In-Reply-To in order, then those of References from the last; the first one that just one
    message of the thread holds is the parent. Null headers were not observed; empty ones were observed to be empty.
    """
    c = m.withColumn("_irt", message_ids_in("in_reply_to")).withColumn("_ref", message_ids_in("references"))
    named = F.concat(F.coalesce("_irt", F.array().cast("array<string>")), F.reverse(F.coalesce("_ref", F.array().cast("array<string>"))))
    c = c.withColumn("_named", F.array_distinct(named))
    each = c.select("thread_id", "message_id", F.posexplode("_named").alias("_rank", "_id"))
    holders = m.filter("rfc822_message_id is not null").groupBy("thread_id", F.col("rfc822_message_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("message_id").alias("_holder"))
    met = each.join(holders, ["thread_id", "_id"], "left")
    best = met.groupBy("thread_id", "message_id").agg(F.min(F.when((F.col("_n") == 1), F.struct("_rank", "_holder", "_id"))).alias("_win"), F.max((F.col("_n") > 1).cast("int")).alias("_many"))
    j = c.join(best, ["thread_id", "message_id"], "left")
    unobserved = F.col("in_reply_to").isNull() & F.col("references").isNull()
    written = F.length(F.trim(F.concat_ws(" ", "in_reply_to", "references"))) > 0
    linkage = (
        F.when(F.col("headers_observed") == F.lit(False), "HEADERS_UNOBSERVED")
        .when((unobserved | ~written) & F.col("rfc822_message_id").isNull(), "NO_MESSAGE_ID")
        .when(unobserved | ~written, "NO_REPLY_HEADERS")
        .when(F.size("_named") == 0, "UNPARSEABLE")
        .when(F.col("_win").isNotNull() & F.array_contains(F.coalesce("_irt", F.array().cast("array<string>")), F.col("_win._id")), "IN_REPLY_TO")
        .when(F.col("_win").isNotNull(), "REFERENCES")
        .when(F.col("_many") == 1, "AMBIGUOUS_PARENT")
        .otherwise("UNRESOLVED_PARENT")
    )
    evidence = F.coalesce(F.col("_win._id"), F.try_element_at("_irt", F.lit(1)), F.try_element_at("_ref", F.lit(-1)))
    links = j.select("thread_id", "message_id", F.col("_win._holder").alias("parent_id"), linkage.alias("linkage"), evidence.alias("evidence"))
    return refuse_cycles(links)


def refuse_cycles(links: DataFrame) -> DataFrame:
    """Messages on a cycle of parents lose their link, as REPLY_CYCLE; those that lead into one keep theirs.

    A cycle has a link to a greater id and one to a smaller or equal id, so threads without both kinds are done. In the
    others, pointers are doubled: after k rounds `up` is 2**k steps above, and walks that end drop out. On a cycle
    2**k steps are a permutation, so once they are more than a thread has messages, the places reached are the cycles.
    No row holds more than its pointer, so a long thread is spread like any other.
    """
    step = links.filter("parent_id is not null").select("thread_id", "message_id", F.col("parent_id").alias("up"))
    both = step.groupBy("thread_id").agg(F.max((F.col("up") > F.col("message_id")).cast("int")).alias("_f"), F.max((F.col("up") < F.col("message_id")).cast("int")).alias("_b"), F.max((F.col("up") == F.col("message_id")).cast("int")).alias("_o"), F.count(F.lit(1)).alias("_n"))
    path = cut(step.join(both.filter("_f + _b = 2 or _o = 1"), "thread_id").select("thread_id", "message_id", "up", "_n"))
    longest = path.agg(F.max("_n")).first()[0] or 0
    path = path.drop("_n")
    for _ in range(longest.bit_length()):
        above = path.select("thread_id", F.col("message_id").alias("up"), F.col("up").alias("_up2"))
        path = cut(path.join(above, ["thread_id", "up"]).select("thread_id", "message_id", F.col("_up2").alias("up")))
        if path.isEmpty():
            break
    on = path.select("thread_id", F.col("up").alias("message_id"), F.lit(True).alias("_cycle")).distinct()
    out = links.join(on, ["thread_id", "message_id"], "left")
    cycle = F.coalesce("_cycle", F.lit(False))
    return out.select("thread_id", "message_id", F.when(~cycle, F.col("parent_id")).alias("parent_id"), F.when(cycle, "REPLY_CYCLE").otherwise(F.col("linkage")).alias("linkage"), "evidence")


def children(links: DataFrame, order: DataFrame) -> DataFrame:
    """parent_id, children in thread order."""
    x = links.filter("parent_id is not null").join(order.select("message_id", "position"), "message_id")
    return x.groupBy("thread_id", "parent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "message_id"))), lambda s: s["message_id"]).alias("children"))


def segments(m: DataFrame, gap_ms: int = DAY_MS) -> DataFrame:
    """Segments of threads: a new one begins gap_ms or more after the last dated message; undated ones never begin one."""
    w = W.partitionBy("thread_id").orderBy("position")
    last = F.last("internal_date_ms", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce((F.col("internal_date_ms") - last >= gap_ms).cast("int"), F.lit(0))
    return m.withColumn("_b", begins).withColumn("segment", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_b")


def participants(m: DataFrame) -> DataFrame:
    """thread_id, address, role, message_id: authors, recipients, reply-to, and mentions in the text alone."""
    heads = [("author", "sender"), ("recipient", "to"), ("recipient", "cc"), ("reply_to", "reply_to")]
    parts = []
    for role, name in heads:
        if name in m.columns:
            raw = F.array_join(name, ", ") if dict(m.dtypes)[name].startswith("array") else F.col(name)
            parts.append(m.withColumn("_a", F.explode(addresses_in_header(raw))).select("thread_id", "message_id", F.col("_a.address").alias("address"), F.lit(role).alias("role")))
    stated = parts[0]
    for p in parts[1:]:
        stated = stated.union(p)
    found = m.withColumn("address", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(f"({ADDRESS})"), F.lit(1)), F.lower)))).select("thread_id", "message_id", "address")
    mentions = found.join(stated.select("message_id", "address").distinct(), ["message_id", "address"], "left_anti").select("thread_id", "message_id", "address", F.lit("mention").alias("role"))
    return stated.union(mentions).distinct()


def mentioned_only(p: DataFrame) -> DataFrame:
    return p.groupBy("thread_id", "address").agg(F.sum((F.col("role") != "mention").cast("int")).alias("n")).filter("n = 0").select("thread_id", "address")
