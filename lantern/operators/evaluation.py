"""Evaluation: recall, rates, intervals, BM25 and latency percentiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, Z = 1.5, 0.75, 1.96


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The 95 % interval of a share; null for no case."""
    p = hits / n
    mid, half, norm = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(n > 0, (mid - half) / norm), F.when(n > 0, (mid + half) / norm)


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of the documents that hold a query word. Document frequencies and lengths are aggregates over all."""
    low = F.lower(F.col(text_col))
    # Words are counted where they stand: no array of a text's words is ever made.
    counts = [F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){re.escape(q)}(?![a-z0-9])")).alias(f"tf{i}") for i, q in enumerate(query)]
    tf = docs.select(id_col, F.regexp_count(low, F.lit("[a-z0-9]+")).alias("len"), *counts)
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(query))])
    j = tf.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(query)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        f = F.col(f"tf{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return j.select(id_col, score.alias("score")).filter("score > 0")


def p90(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Nearest-rank p90 for each stratum; a stratum with a censored (null) sample has none."""
    g = samples.groupBy(by).agg(F.expr(f"percentile_disc(0.9) within group (order by {value})").alias("p90"), F.sum(F.col(value).isNull().cast("int")).alias("censored"))
    return g.select(by, F.when(F.col("censored") == 0, F.col("p90")).alias("p90"))


def recall(required: DataFrame, disclosed: DataFrame, case: str = "case_id", ref: str = "ref") -> DataFrame:
    """case, recall (share of required evidence disclosed), strict (all of it)."""
    j = required.select(case, ref).distinct().join(disclosed.select(case, ref, F.lit(1).alias("got")).distinct(), [case, ref], "left")
    return j.groupBy(case).agg(F.avg(F.coalesce("got", F.lit(0))).alias("recall"), F.every(F.col("got").isNotNull()).alias("strict"))


# --- Cases and arms --------------------------------------------------------------

FRESH_SECONDS, CONTROL = 60.0, "control"


def surfaced_only(required: DataFrame, surfaced: DataFrame, disclosed: DataFrame, case: str = "case_id", ref: str = "ref") -> DataFrame:
    """Required evidence that an answer named and did not carry."""
    return required.select(case, ref).distinct().join(surfaced.select(case, ref), [case, ref], "left_semi").join(disclosed.select(case, ref), [case, ref], "left_anti")


def relevant_fraction(evidence: Column, returned: Column) -> Column:
    return F.when(returned > 0, evidence / returned).otherwise(F.lit(0.0))


def outcome_rates(cases: DataFrame) -> DataFrame:
    """One row: false_not_found, hallucinated_found, inconclusive of cases (answerable, outcome); null where one kind of case is missing,
    as neither rate may be told without the other."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    share = lambda of, hit: F.sum((of & hit).cast("int")) / F.nullif(F.sum(of.cast("int")), F.lit(0))
    out = cases.agg(share(yes, F.col("outcome") == "not_found").alias("false_not_found"), share(no, F.col("outcome") != "not_found").alias("hallucinated_found"), F.avg((F.col("outcome") == "inconclusive").cast("int")).alias("inconclusive"))
    both = F.col("false_not_found").isNotNull() & F.col("hallucinated_found").isNotNull()
    return out.select(*(F.when(both, F.col(c)).alias(c) for c in out.columns))


def partiality() -> Column:
    """The assertions on what an answer says of its own part of the whole: columns claimed, true_length, included, payload (arrays
    of ids), more, roles (map of id to role), reasons (map of id to text), evidence, derived, tagged (arrays of ids)."""
    roles = ("matched", "context", "parent", "child", "requested", "stub", "derived")
    same = (F.size(F.array_except("included", "payload")) == 0) & (F.size(F.array_except("payload", "included")) == 0)
    tagged = F.forall("payload", lambda i: F.coalesce(F.try_element_at("roles", i).isin(*roles), F.lit(False)) & (F.length(F.coalesce(F.try_element_at("reasons", i), F.lit(""))) > 0))
    matched = F.forall(F.array_intersect("evidence", "payload"), lambda i: F.coalesce(F.try_element_at("roles", i) == "matched", F.lit(False)))
    return F.struct(
        F.col("claimed").isNotNull().alias("p1"), F.col("claimed").eqNullSafe(F.col("true_length")).alias("p1a"), same.alias("p2"),
        ((F.size(F.array_distinct("payload")) < F.col("true_length")) == F.col("more")).alias("p3"), (tagged & matched).alias("p4"), (F.size(F.array_except("derived", "tagged")) == 0).alias("p5"),
    )


def freshness(observations: DataFrame) -> DataFrame:
    """stratum, n, censored, p90, meets: strata are never pooled, and one censored sample leaves its stratum without a figure."""
    n = observations.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seconds").isNull().cast("long")).alias("censored"))
    j = n.join(p90(observations, "stratum", "seconds"), "stratum")
    return j.select("stratum", "n", "censored", "p90", (F.col("p90") <= FRESH_SECONDS).alias("meets"))


def position_spread(runs: DataFrame) -> DataFrame:
    """arm, spread: between the best and the worst position's mean recall; null with fewer than two positions."""
    m = runs.filter("position is not null").groupBy("arm", "position").agg(F.avg("recall").alias("r")).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (F.max("r") - F.min("r")).alias("s"))
    return runs.select("arm").distinct().join(m, "arm", "left").select("arm", F.when(F.col("n") >= 2, F.col("s")).alias("spread"))


def cut_loss(runs: DataFrame) -> DataFrame:
    """arm, state, loss, n: mean of pool_recall - recall; a single negative loss is impossible and leaves the arm inconclusive."""
    loss = F.col("pool_recall") - F.col("recall")
    g = runs.groupBy("arm").agg(F.count(loss).alias("n"), F.min(loss).alias("least"), F.avg(loss).alias("mean"))
    state = F.when(F.col("n") == 0, "unmeasured").when(F.col("least") < 0, "inconclusive").otherwise("measured")
    return g.select("arm", state.alias("state"), F.when((F.col("n") > 0) & (F.col("least") >= 0), F.col("mean")).alias("loss"), "n")


def recoverability(runs: DataFrame) -> DataFrame:
    """arm, cases, first, gained, stuck, unseen, levels, failed, and the controls apart (runs: arm, family, failed, declined, and counts)."""
    real = F.col("family") != CONTROL
    ran = real & ~F.col("failed")
    total = lambda c: F.coalesce(F.sum(F.when(ran, F.col(c))), F.lit(0)).cast("long")
    count = lambda c: F.sum(c.cast("long"))
    return runs.groupBy("arm").agg(
        count(ran).alias("cases"), total("first").alias("first"), total("gained").alias("gained"), total("stuck").alias("stuck"), total("unseen").alias("unseen"), F.round(F.avg(F.when(ran, F.col("levels"))), 2).alias("levels"),
        count(real & F.col("failed")).alias("failed"), count(~real).alias("controls"), count(~real & F.col("declined")).alias("controls_declined"), count(~real & (F.col("carried") > 0)).alias("controls_answered"),
    )


def differences(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, before, after of two arms where they differ; what one arm lacks is null there."""
    return before.join(after, by, "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select(by, "before", "after")


def rank_of(scores: DataFrame, by: str, score: str) -> DataFrame:
    """Adds rank from 1, ties counted against each: as many as score no worse."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy(F.desc(score)).rangeBetween(W.unboundedPreceding, W.currentRow)
    return scores.withColumn("rank", F.count(F.lit(1)).over(w))


def running_order(arms: list[str], repeat: Column, index: Column) -> Column:
    """The arms rotated by repeat and query, so that each comes first as often as any other."""
    shift = F.pmod(repeat + index, F.lit(len(arms))).cast("int")
    all_ = F.array(*map(F.lit, arms + arms))
    return F.slice(all_, shift + 1, len(arms))


def completeness(fetched: DataFrame, listed: DataFrame) -> DataFrame:
    """One row: compared, short, over, verdict of thread lengths seen by two ways (thread_id, n): a thread must not be shorter when fetched."""
    j = fetched.select("thread_id", F.col("n").alias("f")).join(listed.select("thread_id", F.col("n").alias("l")), "thread_id")
    g = j.agg(F.count(F.lit(1)).alias("compared"), F.coalesce(F.sum((F.col("f") < F.col("l")).cast("long")), F.lit(0)).alias("short"), F.coalesce(F.sum((F.col("f") > F.col("l")).cast("long")), F.lit(0)).alias("over"))
    return g.withColumn("verdict", F.when(F.col("compared") == 0, "inconclusive").when(F.col("short") > 0, "fail").otherwise("pass"))


# --- Selection without a query -----------------------------------------------------

# Cues by kind, and their weights.
CUES = {
    "assertion": (2, ("that is the position", "as agreed", "position:", "i have updated the record", "please quote that", "is the executed one", "went to signature", "we adopted")),
    "hearsay": (-3, ("i spoke to", "told me", "second hand", "passing on what", "my note from a conversation", "said", "going from memory", "my note says")),
    "proposal": (-3, ("proposing", "suggestion, not a decision", "could we go with", "putting", "tabling", "straw man", "open to being told no", "nothing is settled")),
    "objection": (-3, ("i do not think", "would want to see the numbers", "not comfortable", "reads wrong to me", "pushing back", "i have a problem with that")),
    "reminder": (-2, ("reminder", "for the agenda", "pack says", "the tracker still shows", "carrying", "board pack", "on the current sheet")),
    "hedge": (-1, (
        "may be behind", "could be out of date", "not certain", "check before quoting", "have not checked", "should confirm", "old note", "indicative", "do not hold me to that", "unless corrected",
        "flagging in case", "may have moved", "i may not have the latest", "have not refreshed", "not pulled a fresh copy", "tell me if that is stale",
    )),
}
VALUE = r"\b\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4}\b|\b\d+\.\d+mm\b|\b[A-Z]\d{4}\b|\b\d{2,4}\b"
# Capital words of subjects that name nobody.
NO_TERMS = (
    "The Who What When Where Terms Budget Storage Delegation Inspection Certificates Compliance Readings Tolerance Dispatch Scheduling Indemnity Capacity Throughput "
    "Attribution Handover Completing Transition Allocation Spend Paperwork Record Sign Warehousing"
).split()


def subject_terms(subject: Column) -> Column:
    return F.filter(F.regexp_extract_all(subject, F.lit(r"\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda w: ~w.isin(NO_TERMS))


def cue_counts(text: Column) -> dict[str, Column]:
    """By kind, how many of its cues a text holds."""
    low = F.lower(text)
    return {k: sum((low.contains(c).cast("int") for c in cues), F.lit(0)) for k, (_, cues) in CUES.items()}


def cue_score(text: Column) -> Column:
    return sum((n * CUES[k][0] for k, n in cue_counts(text).items()), F.lit(0))


def unsigned(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)\n-- \n.*$", ""), r"(?U)^\s+|\s+$", "")


def select_messages(m: DataFrame) -> DataFrame:
    """thread_id, best, latest: of the messages that hold a value (and a term of the thread's subject, if it has any), the one of
    the best cues, and of those with a value the newest; ties by date, position, then id (thread_id, message_id, position, epoch_ms, subject, text)."""
    from pyspark.sql import Window as W

    body = unsigned(F.col("text"))
    terms = subject_terms(F.first("subject").over(W.partitionBy("thread_id").orderBy("position", "message_id")))
    x = m.withColumn("_b", body).withColumn("_terms", F.coalesce(terms, F.array().cast("array<string>"))).filter(F.col("_b").rlike(VALUE))
    named = (F.size("_terms") == 0) | F.exists("_terms", lambda t: F.col("_b").contains(t))
    at = F.struct("epoch_ms", "position", "message_id")
    g = x.groupBy("thread_id").agg(F.max(F.when(named, F.struct(cue_score(F.col("_b")).alias("s"), at.alias("at")))).alias("b"), F.max(at).alias("l"))
    return g.select("thread_id", F.col("b.at.message_id").alias("best"), F.col("l.message_id").alias("latest"))
