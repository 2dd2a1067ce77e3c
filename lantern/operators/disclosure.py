"""What is shown: reply-chain floor, scored fill, collapsed runs and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of the fill components.
FILL = {"participant": 5, "term": 4, "temporal": 3, "adjacency": 2, "decision": 1}
ROW, WORD = 151, 2
NEAR_SECONDS, NEAR_POSITIONS = 86_400, 2


def floor_members(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Reply parents and children of evidence messages, each with its first anchor; evidence: message_id, position."""
    up = links.filter("parent_id is not null").join(evidence, "message_id").select(F.col("parent_id").alias("member"), F.col("message_id").alias("anchor"), "position")
    down = links.join(evidence.select(F.col("message_id").alias("parent_id"), "position"), "parent_id").select(F.col("message_id").alias("member"), F.col("parent_id").alias("anchor"), "position")
    all_ = up.union(down).join(evidence.select(F.col("message_id").alias("member")), "member", "left_anti")
    return all_.groupBy("member").agg(F.min(F.struct("position", "anchor")).alias("a")).select(F.col("member").alias("message_id"), F.col("a.anchor").alias("anchor"))


def nearest_hit(m: DataFrame) -> DataFrame:
    """Adds distance, in positions, to the nearest hit of the thread (columns thread_id, position, hit): two running windows."""
    w = W.partitionBy("thread_id").orderBy("position")
    before = F.last(F.when(F.col("hit"), F.col("position")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    # A frame that looks ahead is read anew for each row; the same window backwards is not.
    back = W.partitionBy("thread_id").orderBy(F.desc("position"))
    after = F.last(F.when(F.col("hit"), F.col("position")), ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, 0))
    return m.withColumn("distance", F.least(F.col("position") - before, after - F.col("position")))


def fill_scores(rows: DataFrame) -> DataFrame:
    """Adds value, anchored and admitted to non-hit rows with the components of FILL and temporal_by_query.

    A component that fires on no row of a thread, or on all, says nothing there. A row is admitted if a discriminating
    component that the query itself anchors (participant, term, temporal by the query's window) fires on it.
    """
    w = W.partitionBy("thread_id")
    n = F.count(F.lit(1)).over(w)
    for c in FILL:
        fired = F.sum(F.col(c).cast("int")).over(w)
        rows = rows.withColumn(f"_{c}", F.col(c) & (fired > 0) & (fired < n) & (n >= 2))
    value = sum((F.col(f"_{c}").cast("int") * k for c, k in FILL.items()), F.lit(0))
    anchored = F.col("_participant").cast("int") * FILL["participant"] + F.col("_term").cast("int") * FILL["term"] + (F.col("_temporal") & F.col("temporal_by_query")).cast("int") * FILL["temporal"]
    out = rows.withColumn("value", value).withColumn("anchored", anchored)
    return out.withColumn("admitted", (F.col("value") > 0) & (F.col("anchored") > 0)).drop(*[f"_{c}" for c in FILL])


def collapsed_runs(rows: DataFrame, least: int = 2) -> DataFrame:
    """Runs of consecutive stubs (thread_id, position, stub): first, last and length of those of at least two."""
    w = W.partitionBy("thread_id").orderBy("position")
    island = rows.filter("stub").withColumn("_i", F.col("position") - F.row_number().over(w))
    return island.groupBy("thread_id", "_i").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_i")


def row_tokens(words: Column) -> Column:
    """The price of a row with so many words."""
    return F.lit(ROW) + WORD * words


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of a thread (position, tokens) whose running sum stays within the budget."""
    w = W.partitionBy("thread_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("tokens").over(w)).filter(F.col("running") <= budget)


# Ceilings, and the prices of an answer, of a withheld record, of the best hits that stay whole.
NORMAL, OVERFLOW, STRUCTURE, RECORD, TOP_HITS = 9_000, 12_000, 540, 60, 5
RUN, MEMBER = 120, 3


def degrade_rows(rows: DataFrame, normal: int = NORMAL, overflow: int = OVERFLOW) -> tuple[DataFrame, DataFrame]:
    """The eight steps by which answers shrink until they fit, for any number of answers at once.

    rows: answer, thread_id, rank (of the thread), message_id, position, band (EVIDENCE, FLOOR, FILL, MAP, REQUESTED), score,
    costs (its price now, then at each depth below, to the stub). Every reduction that a step may make is an event with
    what it saves, in the order in which the steps would make it; one running sum per answer then tells which are made: those
    before which the answer did not fit. Steps: 1 fill rows, 2 runs of stubs in threads without hits, 3 hits beyond the best
    five, 4 the floor's depth, 5 runs of stubs in threads with hits, 6 a higher ceiling if the floor alone needs it, 7 threads
    without floor from the last, 8 single rows; floor rows are never withheld, nor the last hit.
    Returns the events made (answer, step, thread_id, message_id, saved), and for each answer its cost before and after, the
    ceiling, the last step, and whether it fits.
    """
    price = lambda n: F.lit(RUN) + MEMBER * n
    hit = F.col("band") == "EVIDENCE"
    thread = W.partitionBy("answer", "thread_id")
    best = F.row_number().over(W.partitionBy("answer").orderBy(F.when(hit, 0).otherwise(1), F.desc("score"), "position", "message_id"))
    x = rows.withColumn("hits", F.sum(hit.cast("int")).over(thread)).withColumn("floors", F.sum((F.col("band") == "FLOOR").cast("int")).over(thread)).withColumn("top", hit & (best <= TOP_HITS))
    step = F.when(F.col("band") == "FILL", 1).when(hit & ~F.col("top"), 3).when(F.col("band") == "FLOOR", 4)
    x = x.withColumn("step", step)
    none = F.lit(None)
    # Depths, one event each.
    deep = x.filter("step is not null and size(costs) > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("costs") - 1)))
    saved = F.element_at("costs", F.col("k")) - F.element_at("costs", F.col("k") + 1)
    order = F.struct("score", (-F.col("position")).alias("p"), F.col("message_id").cast("string").alias("m"), "k")
    events = [deep.select("answer", "step", "thread_id", "message_id", order.alias("o"), saved.cast("long").alias("saved"))]
    # Runs of stubs: what is a stub when their step comes is known beforehand.
    stub = F.when(F.col("band") == "REQUESTED", False).when(F.size("costs") == 1, True).when(F.col("hits") == 0, F.col("step") == 1).otherwise(F.col("step").isNotNull())
    x = x.withColumn("stub", F.coalesce(stub, F.lit(False))).withColumn("least", F.element_at("costs", -1))
    island = x.filter("stub").withColumn("i", F.col("position") - F.row_number().over(thread.orderBy("position")))
    runs = island.groupBy("answer", "thread_id", "i", (F.col("hits") > 0).alias("hit_bearing")).agg(F.count(F.lit(1)).alias("n"), F.sum("least").alias("c"), F.min("position").alias("first"), F.max("position").alias("last")).filter("n >= 2")
    key = lambda a, b, m: F.struct(a.cast(dict(rows.dtypes)["score"]).alias("score"), b.cast("long").alias("p"), m.cast("string").alias("m"), F.lit(0).alias("k"))
    per = runs.groupBy("answer", "hit_bearing").agg(F.sum(F.col("c") - price(F.col("n"))).alias("saved")).filter("saved > 0")
    text = dict(rows.dtypes)["message_id"]
    events.append(per.select("answer", F.when(F.col("hit_bearing"), 5).otherwise(2).alias("step"), none.cast(dict(rows.dtypes)["thread_id"]).alias("thread_id"), none.cast(text).alias("message_id"), key(F.lit(0), F.lit(0), F.lit("")).alias("o"), F.col("saved").cast("long")))
    # What is left of each thread after five steps.
    inside = x.join(runs.select("answer", "thread_id", "first", "last"), (x.answer == runs.answer) & (x.thread_id == runs.thread_id) & x.stub & x.position.between(runs["first"], runs["last"]), "left_semi").select("answer", "thread_id", "message_id").withColumn("in_run", F.lit(True))
    left = x.join(inside, ["answer", "thread_id", "message_id"], "left").withColumn("in_run", F.coalesce("in_run", F.lit(False)))
    now = F.when(F.col("in_run"), 0).when(F.col("step").isNotNull(), F.col("least")).otherwise(F.element_at("costs", 1))
    left = left.withColumn("now", now)
    bundles = runs.groupBy("answer", "thread_id").agg(F.sum(price(F.col("n"))).alias("runs"))
    threads = left.groupBy("answer", "thread_id").agg(F.first("rank").alias("rank"), F.max("hits").alias("hits"), F.max("floors").alias("floors"), F.sum("now").alias("now"), F.sum((~F.col("in_run")).cast("int")).alias("shown")).join(bundles, ["answer", "thread_id"], "left").na.fill(0, ["runs"])
    first_hit = F.min(F.when(F.col("hits") > 0, F.col("rank"))).over(W.partitionBy("answer"))
    threads = threads.withColumn("leaves", (F.col("floors") == 0) & ((F.col("hits") == 0) | (F.col("rank") != first_hit)))
    gone = threads.filter("leaves").withColumn("saved", F.col("now") + F.col("runs") - RECORD * F.col("hits")).filter("saved > 0")
    events.append(gone.select("answer", F.lit(7).alias("step"), "thread_id", none.cast(text).alias("message_id"), key(F.lit(0), -F.col("rank"), F.lit("")).alias("o"), F.col("saved").cast("long")))
    stays = left.join(threads.filter("not leaves").select("answer", "thread_id"), ["answer", "thread_id"], "left_semi").filter("band not in ('FLOOR', 'REQUESTED') and not in_run")
    last_hit = F.row_number().over(W.partitionBy("answer", hit).orderBy(F.desc("score"), "position", "message_id"))
    single = stays.withColumn("last_hit", hit & (last_hit == 1)).filter("not last_hit").withColumn("saved", F.col("now") - F.when(hit, RECORD).otherwise(0)).filter("saved > 0")
    events.append(single.select("answer", F.when(hit, 9).otherwise(8).alias("step"), "thread_id", "message_id", key(F.col("score"), -F.col("position"), F.col("message_id")).alias("o"), F.col("saved").cast("long")))
    all_ = events[0]
    for e in events[1:]:
        all_ = all_.unionByName(e)
    floor_rows = F.sum((F.col("band") == "FLOOR").cast("int"))
    heads = rows.groupBy("answer").agg((F.sum(F.element_at("costs", 1)) + STRUCTURE).alias("before"), floor_rows.alias("floor"))
    cheapest = threads.groupBy("answer").agg((F.sum(F.col("shown") * ROW + F.col("runs")) + STRUCTURE).alias("cheapest"))
    heads = heads.join(cheapest, "answer")
    raised = (F.col("floor") > 0) & (F.col("cheapest") > normal)
    heads = heads.withColumn("ceiling", F.when(raised, overflow).otherwise(normal))
    w = W.partitionBy("answer").orderBy("step", "o").rowsBetween(W.unboundedPreceding, -1)
    j = all_.withColumn("_gone", F.coalesce(F.sum("saved").over(w), F.lit(0))).join(heads.select("answer", "before", "ceiling"), "answer")
    made = j.filter(F.col("before") - F.col("_gone") > F.when(F.col("step") > 6, F.col("ceiling")).otherwise(normal)).select("answer", F.least("step", F.lit(8)).alias("step"), "thread_id", "message_id", "saved")
    sums = made.groupBy("answer").agg(F.sum("saved").alias("saved"), F.max("step").alias("last_step"))
    out = heads.join(sums, "answer", "left").withColumn("after", F.col("before") - F.coalesce("saved", F.lit(0)))
    used = F.when((F.col("ceiling") > normal) & (F.col("after") > normal), F.col("ceiling")).otherwise(F.lit(normal))
    return made, out.select("answer", "before", "after", used.alias("ceiling"), F.coalesce("last_step", F.lit(0)).alias("last_step"), (F.col("after") <= used).alias("fits"))


def depth_for(wanted: Column, has_body: Column, has_text: Column) -> Column:
    """The depth that a message can be shown at: a body only where there is one, a snippet only where there is text."""
    return F.when(wanted.isin("BODY_FULL", "BODY_CLEAN") & has_body, wanted).when((wanted != "STUB") & has_text, "SNIPPET").otherwise("STUB")


def bands(m: DataFrame) -> DataFrame:
    """Adds band and depth to messages with hit, floor, promoted, filled (booleans), has_body, has_text."""
    band = F.when(F.col("hit"), "EVIDENCE").when(F.col("floor"), "FLOOR").when(F.col("filled"), "FILL").otherwise("MAP")
    wanted = F.when(F.col("hit") | (F.col("floor") & F.col("promoted")), "BODY_CLEAN").when(F.col("floor") | F.col("filled"), "SNIPPET").otherwise("STUB")
    return m.withColumn("band", band).withColumn("depth", depth_for(wanted, F.col("has_body"), F.col("has_text")))


def efficiency(rows: DataFrame, dump: DataFrame) -> DataFrame:
    """answer, disclosed, full_dump, relevant tokens, and the share of the dump: rows (answer, band, tokens), dump (answer, tokens)."""
    a = rows.groupBy("answer").agg(F.sum("tokens").alias("disclosed"), F.coalesce(F.sum(F.when(F.col("band").isin("EVIDENCE", "FLOOR"), F.col("tokens"))), F.lit(0)).alias("relevant"))
    b = dump.groupBy("answer").agg((F.sum("tokens") + STRUCTURE).alias("full_dump"))
    return a.join(b, "answer").select("answer", "disclosed", "full_dump", "relevant", F.round(F.col("disclosed") / F.col("full_dump"), 4).alias("share"))
