"""Answers that split and continue: what the steps of degradation left out, as records that an expansion turns back exactly.

disclosure.degrade_rows() tells which reductions were made. Here they become each row's state, a record for each hit that
left, a count for each thread of what else did, and a continuation: the withheld hits in order, in pages that fit both ceilings,
tokens and characters. A row larger than a page goes on in slices, so that what was disclosed and what expands are together
all hits, whole. broken() looks for whatever would not be so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.adapters import cut
from lantern.operators import disclosure, paging

# The ceilings of a response, in tokens and in characters.
TOKENS, CHARS = disclosure.NORMAL, 24_000
#: Parts of a page; a slice's cost is the larger of its shares of both ceilings, rounded up, so pages hold both.
PARTS = 1_000_000
DEPTH_STEPS = (1, 3, 4)


def shown(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (as degrade_rows() takes them) with depth (reductions made), price, cause (why it left: 'split_by_source', 'withheld_record', or null) and present."""
    made = cut(made)  # long plans over the same rows meet again below
    own = made.filter("message_id is not null").groupBy("answer", "message_id").agg(F.count(F.when(F.col("step").isin(*DEPTH_STEPS), 1)).alias("depth"), F.max(F.col("step") == 8).alias("_row"))
    gone = made.filter("step = 7").select("answer", "thread_id", F.lit(True).alias("_thread")).distinct()
    x = rows.join(own, ["answer", "message_id"], "left").join(gone, ["answer", "thread_id"], "left")
    cause = F.when(F.col("_thread"), "split_by_source").when(F.col("_row"), "withheld_record")
    depth = F.coalesce("depth", F.lit(0)).cast("int")
    return x.select(*rows.columns, depth.alias("depth"), F.element_at("costs", depth + 1).alias("price"), cause.alias("cause"), cause.isNull().alias("present"))


def records(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A record (answer, thread_id, message_id, cause, call) for each hit that left, and groups (answer, thread_id, cause, n) of the other rows that did."""
    left = state.filter("not present")
    call = F.concat(F.lit("expand:"), F.col("message_id").cast("string"))
    hits = left.filter("band = 'EVIDENCE'").select("answer", "thread_id", "message_id", "cause", call.alias("call"))
    return hits, left.filter("band <> 'EVIDENCE'").groupBy("answer", "thread_id", "cause").agg(F.count(F.lit(1)).alias("n"))


def slices(rows: DataFrame, tokens: int = TOKENS, chars: int = CHARS) -> DataFrame:
    """rows (answer, message_id, place, tokens, chars) cut into slices (slice, from_char, n_chars, cost) that fit a page; a row without text is one slice."""
    share = lambda c, most: F.ceil(F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)") * PARTS / most).cast("long")
    x = rows.withColumn("_cost", F.greatest(share("tokens", tokens), share("chars", chars), F.lit(1))).withColumn("_chars", F.coalesce(F.col("chars").cast("long"), F.lit(0)))
    step = F.when(F.col("_cost") <= PARTS, F.greatest("_chars", F.lit(1))).otherwise(F.greatest(F.floor(F.col("_chars").cast("decimal(20,0)") * PARTS / F.col("_cost")).cast("long"), F.lit(1)))
    x = x.withColumn("_step", step).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("_chars") / F.col("_step")) - 1, F.lit(0)).cast("long"))))
    begin = F.col("slice") * F.col("_step")
    size = F.least(F.col("_step"), F.col("_chars") - begin)
    cost = F.when(F.col("_chars") == 0, F.least("_cost", F.lit(PARTS))).otherwise(F.ceil(F.col("_cost").cast("decimal(20,0)") * size / F.col("_chars")).cast("long"))
    return x.select("answer", "message_id", "place", "slice", begin.alias("from_char"), size.alias("n_chars"), F.least(cost, F.lit(PARTS)).alias("cost"))


def expand(withheld: DataFrame, texts: DataFrame, tokens: int = TOKENS, chars: int = CHARS) -> DataFrame:
    """answer, page, message_id, slice, from_char, n_chars, next_page (null on the last): the continuation of each answer.

    withheld is what records() gives first; texts has message_id, tokens, chars, which may be null, as may the message: it is one empty
    slice then. Rows come in the order of their messages. Every withheld hit is on some page, all of it, and no page is above a ceiling.
    """
    w = W.partitionBy("answer").orderBy("message_id")
    rows = withheld.select("answer", "message_id").distinct().join(texts.select("message_id", "tokens", "chars"), "message_id", "left").withColumn("place", F.row_number().over(w))
    sliced = slices(rows, tokens, chars).withColumn("at", F.struct("place", "slice"))
    paged = paging.pages(sliced, "answer", "at", "cost", PARTS)
    last = F.max("page").over(W.partitionBy("answer"))
    return paged.select("answer", "page", "message_id", "slice", "from_char", "n_chars", F.when(F.col("page") < last, F.col("page") + 1).alias("next_page"))


def broken(state: DataFrame, made: DataFrame, out: DataFrame, pages: DataFrame, texts: DataFrame) -> DataFrame:
    """answer, hits, reachable, floor_lost, rises, vanished, chars_lost: reachable equals hits, and the others are 0, for every answer that is told honestly.

    floor_lost: floor rows that left; rises: reductions that added to the cost, or an answer that costs more than before; vanished: hits neither
    present nor on a page; chars_lost: of the hits on pages, characters that no slice holds.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    paged = pages.groupBy("answer", "message_id").agg(F.sum("n_chars").alias("_held")).join(texts.select("message_id", "chars"), "message_id", "left")
    hit = F.col("band") == "EVIDENCE"
    x = state.join(paged.select("answer", "message_id", F.lit(True).alias("_paged"), (F.coalesce(F.col("chars"), F.lit(0)) - F.col("_held")).alias("_lost")), ["answer", "message_id"], "left")
    seen = F.col("present") | F.coalesce("_paged", F.lit(False))
    rows = x.groupBy("answer").agg(
        F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(hit & seen, 1)).alias("reachable"), F.count(F.when((F.col("band") == "FLOOR") & ~F.col("present"), 1)).alias("floor_lost"),
        F.count(F.when(hit & ~seen, 1)).alias("vanished"), F.sum(F.abs("_lost")).alias("chars_lost"),
    )
    idle = made.filter("saved < 0").groupBy("answer").agg(F.count(F.lit(1)).alias("_idle"))
    up = out.select("answer", (F.col("after") > F.col("before")).cast("long").alias("_up"))
    all_ = rows.join(idle, "answer", "left").join(up, "answer", "left").withColumn("rises", F.coalesce("_idle", F.lit(0)) + F.coalesce("_up", F.lit(0)))
    return all_.select("answer", *map(zero, ("hits", "reachable", "floor_lost", "rises", "vanished", "chars_lost")))


def refusals(state: DataFrame, out: DataFrame) -> DataFrame:
    """answer, after, ceiling, cause, threads, hits, narrower of the answers that fit no ceiling.

    cause: 'floor' where the present floor at its least depth is above the ceiling by itself, 'requested' where rows asked for by name are, with
    the floor; else 'evidence'. narrower is the call that asks for strictly less: one hit thread of several, else one message, else none.
    """
    least = F.element_at("costs", -1)
    of = lambda *b: F.sum(F.when(F.col("band").isin(*b) & F.col("present"), least).otherwise(0))
    g = state.groupBy("answer").agg(
        of("FLOOR").alias("_floor"), of("FLOOR", "REQUESTED").alias("_named"), F.countDistinct(F.when((F.col("band") == "EVIDENCE"), F.col("thread_id"))).alias("threads"), F.count(F.when(F.col("band") == "EVIDENCE", 1)).alias("hits"),
        F.min(F.when(F.col("band") == "EVIDENCE", F.struct("rank", F.col("thread_id").cast("string").alias("t"), (-F.col("score")).alias("s"), F.col("message_id").cast("string").alias("m")))).alias("_first"),
    )
    x = out.filter("not fits").join(g, "answer")
    above = lambda c: F.col(c) + disclosure.STRUCTURE > F.col("ceiling")
    cause = F.when(above("_floor"), "floor").when(above("_named"), "requested").otherwise("evidence")
    narrower = F.when(F.col("threads") > 1, F.concat(F.lit("thread:"), F.col("_first.t"))).when(F.col("hits") > 1, F.concat(F.lit("message:"), F.col("_first.m")))
    return x.select("answer", "after", "ceiling", cause.alias("cause"), "threads", "hits", narrower.alias("narrower"))
