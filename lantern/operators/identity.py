"""Identity against likeness: entities are what deterministic keys make equal; what only looks alike is a pair, and merges nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.adapters import cut

#: Rounds of label propagation at most.
ROUNDS = 64
#: Names of more entities than this are no likeness: the name says nothing.
COMMON = 20


def key_digest(connector: Column, kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", connector, kind, value), 256), 1, 12)


def entities(keys: DataFrame) -> DataFrame:
    """entity_id, node_id for each node: nodes that share a key, directly or over others, are one entity.

    keys: node_id, connector, kind, value; rows with a null value are no key, and a node without any has no entity. A key
    joins its nodes by the least of them, never each with each; labels then spread along keys and are shortcut each round, and
    every round is cut. The id is a digest of the entity's keys, so it does not depend on who asked.
    """
    k = cut(keys.filter("value is not null and node_id is not null").select(F.col("node_id").cast("string"), key_digest(F.col("connector"), F.col("kind"), F.col("value")).alias("key")).distinct())
    label = cut(k.select("node_id", F.col("node_id").alias("label")).distinct())
    for _ in range(ROUNDS):
        by_key = k.join(label, "node_id").groupBy("key").agg(F.min("label").alias("label"))
        near = k.join(by_key, "key").groupBy("node_id").agg(F.min("label").alias("near"))
        # Where a label's own node has moved on, follow it.
        ahead = near.select(F.col("node_id").alias("_n"), F.col("near").alias("_to"))
        moved = label.join(near, "node_id").join(ahead, F.col("near") == F.col("_n"), "left")
        moved = cut(moved.select("node_id", F.least("near", F.coalesce("_to", "near")).alias("label"), F.col("label").alias("was")))
        label = moved.select("node_id", "label")
        if moved.filter("label <> was").isEmpty():
            break
    else:
        raise RuntimeError("the entities did not settle")
    whole = k.join(label, "node_id").select("label", "key").distinct().groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("key")), "\x1e").alias("keys"))
    name = whole.select("label", F.concat(F.lit("entity/"), F.substring(F.sha2("keys", 256), 1, 16)).alias("entity_id"))
    return label.join(name, "label").select("entity_id", "node_id")


def candidates(names: DataFrame, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Pairs (left, right, basis, confidence, status) of entities with one folded display name, and the names that too many carry (name, n).

    names: entity_id, name. Pairs are between different entities, left the smaller, and stay candidates: only a source confirms
    one. A name of more entities than common gives no pairs, and is told. Null and blank names are no likeness.
    """
    folded = F.trim(F.regexp_replace(F.lower("name"), r"[\s\p{P}]+", " "))
    n = names.select("entity_id", folded.alias("name")).filter("name <> ''").distinct()
    sizes = n.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    some = n.join(sizes.filter((F.col("n") > 1) & (F.col("n") <= common)), "name")
    a, b = (some.select("name", F.col("entity_id").alias(x), "n") for x in ("left", "right"))
    pairs = a.join(b.drop("n"), "name").filter(F.col("left") < F.col("right"))
    pairs = pairs.groupBy("left", "right").agg(F.min("n").alias("n"))
    out = pairs.select("left", "right", F.lit("display_name").alias("basis"), F.round(1 / F.col("n"), 4).alias("confidence"), F.lit("candidate").alias("status"))
    return out, sizes.filter(F.col("n") > common)
