"""What a connector provides, as DataFrames: what it can search for, ids, containers, items at a depth, versions and scopes.

Facts of a query do not depend on a source. A source translates them to its own language and names what it could not carry, so that
a narrower search is told and not only made.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.plans import ladder
from lantern.plans.query import analyse

# The depths of an item, and the characters of its snippet.
DEPTHS, SNIPPET = ("stub", "snippet", "body"), 200


@dataclass(frozen=True)
class Capabilities:
    """Declared, so that a plan needs no call to find out."""

    connector: str
    native_search: bool = True
    search_operators: tuple[str, ...] = ()
    container_kind: str = "thread"
    revisions: bool = False
    change_feed: str = "none"
    max_ids_per_fetch: int = 100


@dataclass(frozen=True)
class Facts:
    text: str
    terms: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    excluded_phrases: tuple[str, ...] = ()
    participants: tuple[str, ...] = ()
    recipients: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None
    identifiers: tuple[str, ...] = ()


@dataclass(frozen=True)
class Native:
    query: str
    unrepresentable: tuple[str, ...] = field(default=())


def translate(facts: Facts, capabilities: Capabilities) -> Native:
    """Facts in the query language: phrases, absent phrases, terms, people, dates, identifiers. A phrase with a quotation mark has no
    written form, nor has an operator that the source did not declare."""
    parts, left = [], []
    for sign, phrases in (("", facts.phrases), ("-", facts.excluded_phrases)):
        for p in phrases:
            (left if '"' in p else parts).append(f"{sign}phrase:{p}" if '"' in p else f'{sign}"{p}"')
    parts += facts.terms
    wanted = [("from", facts.participants), ("to", facts.recipients), ("after", (facts.after,)), ("before", (facts.before,)), ("rfc822msgid", facts.identifiers)]
    for name, values in wanted:
        for v in filter(None, values):
            (parts if name in capabilities.search_operators else left).append(f"{name}:{v}")
    return Native(" ".join(filter(None, parts)) or facts.text, tuple(left))


def search(messages: DataFrame, native: Native, now: datetime, max_ids: int) -> DataFrame:
    """message_id, thread_id, truncated: the first max_ids messages, by id, that the whole query finds; truncated where there are more.

    A query that asks for nothing finds nothing.
    """
    p = analyse(native.query, now)
    probes = ladder.filtered(p)
    if not probes:
        return messages.select("message_id", "thread_id", F.lit(False).alias("truncated")).limit(0)
    some = ladder.hits(messages, p, probes[0]).select("message_id", "thread_id").distinct().orderBy("message_id").limit(max_ids + 1)
    n = F.row_number().over(W.orderBy("message_id"))  # max_ids + 1 rows
    return some.withColumn("_n", n).withColumn("truncated", F.max("_n").over(W.partitionBy()) > max_ids).filter(F.col("_n") <= max_ids).drop("_n")


def containers(messages: DataFrame, refs: DataFrame, order: str = "position") -> DataFrame:
    """thread_id, message_id, position, n: the rows of the containers asked for (refs: thread_id), each with the container's own count.

    A container that is not there has one row without a message and n = 0.
    """
    asked = refs.select("thread_id").distinct()
    counts = messages.join(asked, "thread_id", "left_semi").groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    rows = messages.select("thread_id", "message_id", F.col(order).alias("position"))
    return asked.join(rows, "thread_id", "left").join(counts, "thread_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def items(messages: DataFrame, refs: DataFrame, depth: str) -> DataFrame:
    """message_id, thread_id, depth, content, chars, found for each of refs (message_id), in the depth asked for; a stub has no content."""
    if depth not in DEPTHS:
        raise ValueError(f"a depth is one of {', '.join(DEPTHS)}")
    content = {"stub": F.lit(None).cast("string"), "snippet": F.substring("text", 1, SNIPPET), "body": F.col("text")}[depth]
    rows = messages.select("message_id", "thread_id", content.alias("content"), F.char_length("text").cast("long").alias("chars"), F.lit(True).alias("found"))
    return refs.select("message_id").distinct().join(rows, "message_id", "left").select("message_id", "thread_id", F.lit(depth).alias("depth"), "content", "chars", F.coalesce("found", F.lit(False)).alias("found"))


def versions(messages: DataFrame) -> DataFrame:
    """message_id, revision: the version a message has now, by its text; a source with revisions of its own would give those."""
    return messages.select("message_id", F.sha2(F.col("text").cast("binary"), 256).alias("revision"))
