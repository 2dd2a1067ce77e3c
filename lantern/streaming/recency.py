"""Recency: messages that arrived after a mailbox's watermark, rechecked against a query by what can be told without its index.

A walk takes a mailbox's additions above its watermark. At most MAX_FETCH of them, by message id, are fetched and rechecked: a
fetched message is surfaced unless it contradicts the query, which only people, dates, attachments and labels can show;
what was not observed is not checked, and free text never is. Additions beyond the bound are named, not dropped. A mailbox
without a watermark has no place to walk from, one whose watermark the feed no longer reaches starts anew, and both say so.

reconcile() computes all walks of a table at once by windows; walked() does the same on a stream, with the watermark
as state of its mailbox, so that it goes on where it stood after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lantern.functions.text import STOPWORDS, fold_text
from lantern.plans.query import OPERATORS, analyse

# Messages that one walk fetches at most, and the units that a walk and a fetch cost.
MAX_FETCH, WALK_UNITS, FETCH_UNITS = 8, 2, 20
# The operators that name people, and the headers' order of checks.
PEOPLE, CHECKS = ("from", "to", "cc"), ("participant", "date", "has_attachment", "label")

FACTS = "query_id long, applicable boolean, people array<string>, start_us long, end_us long, attachment boolean, wanted_labels array<string>, free_text boolean"


def facts(queries: DataFrame, now: datetime, label_ids: dict[str, str] | None = None) -> DataFrame:
    """What each query (query_id, query) asks that a recheck can tell; label_ids: the labels whose ids are known, by folded name.

    A query without constraints, null ones included, is not applicable.
    """
    known = label_ids or {}

    def of(i: int | None, q: str | None) -> dict:
        p = analyse(q or "", now)
        ops = [t for t in p.tokens if t.kind == "operator" and not t.negated and t.name in OPERATORS]
        us = lambda t: None if t is None else int(t.timestamp() * 1_000_000)
        return {
            "query_id": i, "applicable": bool(p.constraints), "people": sorted({fold_text(t.value) for t in ops if t.name in PEOPLE}), "start_us": us(p.window.start) if p.window else None, "end_us": us(p.window.end) if p.window else None,
            "attachment": any(t.name == "has" and fold_text(t.value) == "attachment" for t in ops), "wanted_labels": sorted({known[fold_text(t.value)] for t in ops if t.name == "label" and fold_text(t.value) in known}),
            "free_text": any(t.kind == "phrase" or (t.kind == "term" and fold_text(t.value) not in STOPWORDS) for t in p.tokens if not t.negated),
        }

    schema = pa.schema([("query_id", pa.int64()), ("applicable", pa.bool_()), ("people", pa.list_(pa.string())), ("start_us", pa.int64()), ("end_us", pa.int64()), ("attachment", pa.bool_()), ("wanted_labels", pa.list_(pa.string())), ("free_text", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([of(i, q) for i, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], schema=schema)

    return queries.select(F.col("query_id").cast("long"), F.col("query").cast("string")).mapInArrow(run, FACTS)


def recheck() -> Column:
    """passed, checked (the checks made, in order, to the first that fails), failed_on, residual_free_text, of a message's addresses, ts_us,
    has_attachment and labels under a query's facts.

    A message that shows no people or attachment has none; a date or labels that were not observed are not checked.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    labels = F.col("labels").isNotNull() & (F.size("wanted_labels") > 0)
    made = {"participant": F.size("people") > 0, "date": (F.col("start_us").isNotNull() | F.col("end_us").isNotNull()) & F.col("ts_us").isNotNull(), "has_attachment": F.col("attachment"), "label": labels}
    fails = {
        "participant": ~yes(F.arrays_overlap("people", "addresses")), "date": yes(F.col("ts_us") < F.col("start_us")) | yes(F.col("ts_us") >= F.col("end_us")),
        "has_attachment": ~yes(F.col("has_attachment")), "label": ~yes(F.arrays_overlap("wanted_labels", "labels")),
    }
    failed = F.coalesce(*(F.when(yes(made[k]) & fails[k], k) for k in CHECKS))
    last = F.coalesce(F.array_position(F.lit(list(CHECKS)), failed), F.lit(len(CHECKS)))
    checked = F.array_compact(F.array(*(F.when(yes(made[k]) & (F.lit(n) <= last), k) for n, k in enumerate(CHECKS, 1))))
    return F.struct(failed.isNull().alias("passed"), checked.alias("checked"), failed.alias("failed_on"), F.col("free_text").alias("residual_free_text"))


def reason(since: Column, checked: Column) -> Column:
    """The sentence that a surfaced message carries."""
    # Its words.
    names = F.when(F.size(checked) > 0, F.array_join(checked, ", ")).otherwise("none")
    return F.concat(F.lit("history.list messageAdded since "), since.cast("string"), F.lit("; constraints re-checked locally: ["), names, F.lit("]; free-text terms NOT re-checked - Gmail q did not match this message"))


COLUMNS = ("mailbox", "walk", "message_id", "history_id", "since", "passed", "checked", "failed_on", "free_text", "status", "reason")


def _verdicts(feed: DataFrame, asked: DataFrame) -> DataFrame:
    """feed with the verdict on each addition; mailboxes without a query, or with one that is not applicable, have no walk."""
    rows = feed.filter("history_id is not null").join(asked.filter("applicable").withColumnRenamed("query_id", "_query"), F.col("mailbox") == F.col("_query"))
    return rows.withColumn("v", recheck()).select("mailbox", "walk", F.col("message_id").cast("string"), F.col("history_id").cast("long"), F.col("oldest").cast("long"), "v.passed", "v.checked", "v.failed_on", F.col("v.residual_free_text").alias("free_text"))


def _told(rows: DataFrame) -> DataFrame:
    surfaced = F.col("status") == "surfaced"
    known = F.col("status").isin("surfaced", "contradicted")
    hide = lambda c: F.when(known, F.col(c)).alias(c)
    return rows.select("mailbox", "walk", "message_id", "history_id", "since", hide("passed"), hide("checked"), hide("failed_on"), "free_text", "status", F.when(surfaced, reason(F.col("since"), F.col("checked"))).alias("reason"))


def reconcile(feed: DataFrame, asked: DataFrame, max_fetch: int = MAX_FETCH) -> DataFrame:
    """Every addition with its status (COLUMNS): surfaced, contradicted, beyond_cap, below_watermark, no_watermark or rebaselined.

    feed: mailbox, walk (ordered), message_id (one row in a walk), history_id, oldest (the first id that the feed still held then, or null),
    addresses, ts_us, has_attachment, labels. asked: facts() with the mailbox as query_id. The watermark of a walk is the
    highest history id of its mailbox's earlier walks. Rows without a history id are left out. The fetched ones are found by a limit
    within groups and joined back, so a walk of one mailbox may hold most rows.
    """
    rows = _verdicts(feed, asked)
    marks = rows.groupBy("mailbox", "walk").agg(F.max("history_id").alias("latest"))
    earlier = W.partitionBy("mailbox").orderBy("walk").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select("mailbox", "walk", F.max("latest").over(earlier).alias("since"))
    rows = rows.join(marks, ["mailbox", "walk"])
    state = F.when(F.col("since").isNull(), "no_watermark").when(F.col("since") < F.col("oldest") - 1, "rebaselined").when(F.col("history_id") <= F.col("since"), "below_watermark")
    rows = rows.withColumn("status", state)
    open_ = rows.filter("status is null").select("mailbox", "walk", "message_id")
    nth = F.row_number().over(W.partitionBy("mailbox", "walk").orderBy("message_id"))
    fetched = open_.withColumn("_n", nth).filter(F.col("_n") <= max_fetch).drop("_n").withColumn("_fetched", F.lit(True))
    out = rows.join(fetched, ["mailbox", "walk", "message_id"], "left")
    judged = F.when(F.col("_fetched"), F.when(F.col("passed"), "surfaced").otherwise("contradicted")).otherwise("beyond_cap")
    return _told(out.withColumn("status", F.coalesce("status", judged)))


class _Walks(StatefulProcessor):
    """The watermark of a mailbox, and one walk for each batch that brings it additions; holds max_fetch rows at a time."""

    def __init__(self, max_fetch: int):
        self.max_fetch = max_fetch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("watermark", "history_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = self.mark.get()[0] if self.mark.exists() else None
        latest, best, out = since, None, ["mailbox", "walk", "message_id", "history_id", "since", "passed", "checked", "failed_on", "free_text", "status"]
        for pdf in rows:
            top = int(pdf["history_id"].max())
            latest = top if latest is None else max(latest, top)
            pdf = pdf.assign(since=pd.array([since] * len(pdf), "Int64"))
            lost = pdf["oldest"].notna() & (since is not None) & (pdf["oldest"] - 1 > (since or 0))
            below = pdf["history_id"] <= (since or 0)
            status = pd.Series("open", pdf.index, dtype=object).mask(below, "below_watermark").mask(lost, "rebaselined")
            pdf = pdf.assign(status="no_watermark" if since is None else status)
            # Of the open ones only the first by id are held; what they displace is told at once.
            open_ = pdf[pdf["status"] == "open"]
            both = (open_ if best is None else pd.concat([best, open_])).sort_values("message_id", kind="stable")
            best = both.head(self.max_fetch)
            yield pd.concat([pdf[pdf["status"] != "open"], both.iloc[self.max_fetch :].assign(status="beyond_cap")])[out]
        if best is not None and len(best):
            yield best.assign(status=best["passed"].map({True: "surfaced", False: "contradicted"}))[out]
        if latest is not None:
            self.mark.update((latest,))

    def close(self) -> None:
        pass


def walked(feed: DataFrame, asked: DataFrame, max_fetch: int = MAX_FETCH) -> DataFrame:
    """reconcile() on a stream: each micro-batch is a walk of the mailboxes in it, whatever its rows' walk says.

    asked is a table; feed has the columns that reconcile() takes. Needs the RocksDB state store, which keeps one number a mailbox; a task
    holds max_fetch rows of a mailbox, however many a micro-batch brings.
    """
    rows = _verdicts(feed, asked)
    walk = dict(rows.dtypes)["walk"]
    schema = f"mailbox long, walk {walk}, message_id string, history_id long, since long, passed boolean, checked array<string>, failed_on string, free_text boolean, status string"
    rows = rows.withColumn("mailbox", F.col("mailbox").cast("long"))
    return _told(rows.groupBy("mailbox").transformWithStateInPandas(_Walks(max_fetch), schema, "Append", "None"))


def accounts(rows: DataFrame) -> DataFrame:
    """mailbox, walk, state, since, latest, candidates, fetched, surfaced, quota_units of each walk, from its rows."""
    of = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    g = rows.groupBy("mailbox", "walk").agg(
        F.max(F.when(F.col("status").isin("no_watermark", "rebaselined"), F.col("status"))).alias("state"), F.max("since").alias("since"), F.max("history_id").alias("latest"),
        of("surfaced", "contradicted", "beyond_cap").alias("candidates"), of("surfaced", "contradicted").alias("fetched"), of("surfaced").alias("surfaced"),
    )
    ran = F.coalesce("state", F.lit("ran"))
    units = F.when(ran == "no_watermark", 0).otherwise(WALK_UNITS + FETCH_UNITS * F.col("fetched")).cast("long")
    return g.withColumn("state", ran).withColumn("quota_units", units)
