"""The evidence graph: observed, stated and inferred edges, pruning, merging and re-authorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_CANDIDATES = 4
URL = r"(?i:https?)://[^\s\"'<>)\]]+"


def observed_edges(links: DataFrame, participants: DataFrame) -> DataFrame:
    """source, target, relation: reply_to, thread_member, authored_by and sent_to."""
    e = lambda df, a, b, r: df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(r).alias("relation"))
    out = e(links.filter("parent_id is not null"), "message_id", "parent_id", "reply_to").union(e(links, "message_id", "thread_id", "thread_member"))
    for role, relation in (("author", "authored_by"), ("recipient", "sent_to")):
        out = out.union(e(participants.filter(F.col("role") == role), "message_id", "address", relation))
    return out.distinct()


def link_edges(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """Edges from nodes (node_id, text) to the nodes that own their URLs (known: url, node_id); unknown ones have null targets."""
    urls = nodes.select(F.col("node_id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({URL})"), F.lit(1)))).alias("url"))
    return urls.join(known.select("url", F.col("node_id").alias("target")), "url", "left").select("source", "target", "url", F.lit("links_to").alias("relation"))


def inferred_edges(matches: DataFrame) -> DataFrame:
    """For an assertion with 2 to 4 matched candidates, an edge to each with confidence 1/n; others are declined."""
    n = F.count(F.lit(1)).over(W.partitionBy("source"))
    return matches.withColumn("n", n).filter((F.col("n") >= 2) & (F.col("n") <= MAX_CANDIDATES)).select("source", F.col("candidate").alias("target"), F.lit("potentially_supersedes").alias("relation"), F.round(1 / F.col("n"), 4).alias("confidence"))


def prune(nodes: DataFrame, edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and the first messages by response order; persons without a surviving edge go, and edges with lost ends."""
    anchors = nodes.filter("kind <> 'message'")
    room = max(0, max_nodes - anchors.count())
    kept = anchors.unionByName(nodes.filter("kind = 'message'").orderBy("position", "node_id").limit(room))
    ids = kept.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    touched = e.select(F.col("source").alias("node_id")).union(e.select("target")).distinct()
    return kept.filter("kind <> 'person'").unionByName(kept.filter("kind = 'person'").join(touched, "node_id", "left_semi")), e.select(edges.columns)


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """node_id with different revisions in two graphs."""
    j = a.select("node_id", F.col("revision").alias("x")).join(b.select("node_id", F.col("revision").alias("y")), "node_id")
    return j.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node_id")


def merge(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The union by id; new nodes up to the cap, edges with both ends. A version conflict refuses the whole merge."""
    if not conflicts(nodes, more_nodes).isEmpty():
        raise ValueError("the graphs hold different versions of a node")
    new, room = more_nodes.join(nodes.select("node_id"), "node_id", "left_anti"), max(0, max_nodes - nodes.count())
    if new.count() > room:  # only then does anything have to be put in order
        new = new.orderBy("node_id").limit(room)
    out = nodes.unionByName(new.select(nodes.columns))
    ids = out.select("node_id")
    fresh = more_edges.join(edges.select("edge_id"), "edge_id", "left_anti").select(edges.columns)
    e = edges.unionByName(fresh).join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return out, e.select(edges.columns)


def freshness(nodes: DataFrame, current: DataFrame) -> DataFrame:
    """node_id, freshness: by the version that the source shows now (node_id, revision, deleted)."""
    j = nodes.select("node_id", "revision").join(current.select("node_id", F.col("revision").alias("now"), "deleted", F.lit(True).alias("known")), "node_id", "left")
    return j.select("node_id", F.when(F.col("known").isNull(), "unverifiable").when(F.col("deleted"), "gone").when(F.col("revision").isNull(), "unverifiable").when(F.col("revision") != F.col("now"), "stale").otherwise("fresh").alias("freshness"))


def disclose(nodes: DataFrame, edges: DataFrame, current: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages that are permitted and fresh or stale; derived nodes that an edge joins to one; edges with both ends."""
    seen = nodes.join(freshness(nodes, current).filter("freshness in ('fresh', 'stale')"), "node_id").join(allowed.select("node_id"), "node_id", "left_semi").filter("kind = 'message'").drop("freshness")
    ids = seen.select("node_id")
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))
    near = ends.join(ids.withColumnRenamed("node_id", "a"), "a", "left_semi").select(F.col("b").alias("node_id")).distinct()
    kept = seen.unionByName(nodes.filter("kind <> 'message'").join(near, "node_id", "left_semi").select(seen.columns))
    k = kept.select("node_id")
    return kept, edges.join(k.withColumnRenamed("node_id", "source"), "source", "left_semi").join(k.withColumnRenamed("node_id", "target"), "target", "left_semi").select(edges.columns)

