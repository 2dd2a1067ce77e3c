"""Sharding: balanced label propagation.

Documents begin in hashed shards. In each round the documents of a group vote, weighted by how many they are, and
those outside the shard with most votes move there if its quota has room; moves are granted in hashed order up to
the quota. At the end shards over their size give documents up, and these and the documents without
links fill the gaps, so that counts differ by one at most. Documents of one group, shard and block act alike, so rounds
run over such cells and not over documents; blocks keep cells small in groups of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.llm.common import checkpoint, running_totals, written

SHARDS, ROUNDS = 40, 8
#: Documents that a cell holds, about; buckets in running sums.
CELL, BUCKETS = 64, 1024
#: While groups gather, a shard may hold so much more than its share of documents with links; it gives them up at the end.
SLACK = 0.5


def text_group(text: Column) -> Column:
    """The group of a text: 128 bits of hash; null texts are in none."""
    return F.when(text.isNotNull(), F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text))))


def propagate(cells: DataFrame, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """cells (hub, start, block, w, shard) after label propagation; no shard gets members beyond quota by a move."""
    for _ in range(rounds):
        load = {r.shard: r.w for r in cells.groupBy("shard").agg(F.sum("w").alias("w")).collect()}  # a row a shard
        if not load:
            break
        held = F.create_map(*[F.lit(x) for kv in load.items() for x in kv])
        room = lambda c: F.lit(quota) - F.coalesce(F.element_at(held, F.col(c)), F.lit(0))  # noqa: E731, B023
        votes = cells.groupBy("hub", "shard").agg(F.sum("w").alias("votes"))
        rank = F.struct("votes", F.xxhash64("hub", "shard").alias("tie"), "shard")
        best = votes.filter(room("shard") > 0).groupBy("hub").agg(F.max(rank).alias("best"))
        mine = votes.select("hub", "shard", rank.alias("mine"))
        wish = mine.join(best, "hub").filter(F.col("mine") < F.col("best")).select("hub", "shard", F.col("best.shard").alias("target"))
        movers = cells.join(wish, ["hub", "shard"]).withColumn("bucket", F.pmod(F.xxhash64("hub"), F.lit(BUCKETS)).cast("int"))
        granted = running_totals(movers, ["target"], "bucket", [F.col("hub"), F.col("start"), F.col("block")], F.col("w"), "before")
        granted = granted.filter(F.col("before") + F.col("w") <= room("target")).select("hub", "start", "block", "target")
        granted = checkpoint(granted)
        if granted.isEmpty():
            break
        cells = checkpoint(cells.join(granted, ["hub", "start", "block"], "left").select("hub", "start", "block", "w", F.coalesce("target", "shard").alias("shard")))
    return cells


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law "rows".

    Counts of shards differ by one at most; documents of equal texts share a shard as far as that allows. A null text
    has size 16, checksum 0 and no group; equal empty texts are a group. Null and repeated ids are rows like any
    other. slot numbers the rows of a shard from 0 without gaps.
    """
    text, doc_id = docs[text_col], docs[id_col].cast("long")
    facts = docs.select(doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), text_group(text).alias("hub"))
    facts = written(facts.withColumn("spread", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())), "shard-facts")
    total = facts.count()
    low, more = divmod(total, shards)
    hubs = facts.filter("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    start = F.pmod(F.col("spread"), F.lit(shards)).cast("int")
    blocks = F.ceil(F.col("n") / (CELL * shards)).cast("long")
    block = F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("spread"), blocks)).cast("int")
    linked = facts.join(hubs, "hub", "left").select("doc_id", "size", "text_crc32", "spread", F.when(F.col("n").isNotNull(), F.col("hub")).alias("hub"), start.alias("start"), block.alias("block"))
    linked = written(linked, "shard-linked")
    cells = linked.filter("hub is not null").groupBy("hub", "start", "block").agg(F.count(F.lit(1)).alias("w")).withColumn("shard", F.col("start"))
    cells = propagate(checkpoint(cells), int(low * (1 + SLACK)) + 1)
    # Places in a shard: whole cells one after another, and documents within a cell.
    cells = cells.withColumn("bucket", F.pmod(F.xxhash64("hub", "start", "block"), F.lit(BUCKETS)).cast("int"))
    cells = running_totals(cells, ["shard"], "bucket", [F.col("hub"), F.col("start"), F.col("block")], F.col("w"), "before")
    quota = F.lit(low) + (F.col("shard") < more).cast("int")
    at = W.partitionBy("hub", "start", "block").orderBy("spread")
    placed = linked.filter("hub is not null").join(cells.select("hub", "start", "block", "shard", "before"), ["hub", "start", "block"])
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(at) - 1)
    stay = F.when(F.col("place") < quota, F.col("shard"))
    columns = ["doc_id", "size", "text_crc32", "spread"]
    # What is given up goes to its new places group by group; a large group takes several buckets.
    spread = F.pmod(F.xxhash64("spread"), F.lit(BUCKETS)).cast("int")
    group = (F.pmod(F.xxhash64("hub"), F.lit(BUCKETS // 16)) * 16 + F.pmod(F.xxhash64("start", "block"), F.lit(16))).cast("int")
    placed = placed.select(*columns, "hub", group.alias("bucket"), stay.alias("shard"))
    placed = written(placed.union(linked.filter("hub is null").select(*columns, "hub", spread, F.lit(None).cast("int"))), "shard-placed")
    held = {r.shard: r.n for r in placed.filter("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    gaps, ends = 0, []
    for s in range(shards):
        gaps += low + (s < more) - held.get(s, 0)
        ends.append(gaps)
    loose = running_totals(placed.filter("shard is null"), [], "bucket", [F.col("hub").asc_nulls_last(), F.col("spread")], F.lit(1), "place")
    fill = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("place"))).cast("int")
    done = placed.filter("shard is not null").select(*columns, "shard").unionByName(loose.select(*columns, fill.alias("shard")))
    done = running_totals(done.withColumn("bucket", spread), ["shard"], "bucket", [F.col("spread")], F.lit(1), "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
