"""Recency as a table of walks and as a stream, against each other and by hand."""

from __future__ import annotations

import os
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lantern.streaming import recency
from lantern.streaming.feed import read

NOW = datetime(2026, 3, 15, 12, tzinfo=UTC)
FEED = "mailbox long, walk int, message_id string, history_id long, oldest long, addresses array<string>, ts_us long, has_attachment boolean, labels array<string>, extra string"
DAY = 86_400_000_000
AT = int(datetime(2026, 3, 1, tzinfo=UTC).timestamp() * 1_000_000)


def _feed(spark):
    rows = []
    for w in (1, 2, 3):
        for box in (1, 2, 3, 4):
            for k in range(12 if box == 1 else 3):
                h = w * 100 + k
                rows.append((box, w, f"m{(k * 7) % 12:02d}-{w}", h, None, ["amy@x.example"] if k % 2 else None, AT + w * DAY, k % 3 == 0 if k % 4 else None, ["INBOX"] if k % 5 else None, "x"))
    rows += [(1, 3, "late", 150, None, ["amy@x.example"], AT, True, ["INBOX"], "x"), (4, 3, "lost", 399, 350, None, None, None, None, "x"), (5, 2, "none", None, None, None, None, None, None, "x"), (None, 2, "nobody", 7, None, None, None, None, None, "x")]
    return spark.createDataFrame(rows, FEED)


def _asked(spark):
    queries = [(1, "from:amy@x.example total"), (2, "after:2026/03/04 has:attachment label:inbox"), (3, "the"), (4, "label:other alpha"), (None, "alpha")]
    return recency.facts(spark.createDataFrame(queries, "query_id long, query string"), NOW, {"inbox": "INBOX"})


def test_facts(spark):
    got = {r.query_id: r for r in _asked(spark).collect()}
    assert (got[1].people, got[1].free_text, got[1].applicable) == (["amy@x.example"], True, True) and not got[3].applicable
    assert got[2].attachment and got[2].wanted_labels == ["INBOX"] and not got[2].free_text and got[2].start_us and got[2].end_us is None
    assert got[4].wanted_labels == [] and recency.facts(spark.createDataFrame([(9, None)], "query_id long, query string"), NOW).first().applicable is False


def test_walks(spark):
    rows = recency.reconcile(_feed(spark), _asked(spark)).collect()
    by = {(r.mailbox, r.message_id): r for r in rows}
    assert {r.mailbox for r in rows} == {1, 2, 4}  # the query of 3 names nothing, 5 has no query and no history id, null meets no query
    assert {r.status for r in rows if r.walk == 1} == {"no_watermark"} and by[1, "late"].status == "below_watermark" and by[4, "lost"].status == "rebaselined"
    second = sorted((r for r in rows if r.mailbox == 1 and r.walk == 2), key=lambda r: r.message_id)
    assert [r.status == "beyond_cap" for r in second] == [False] * 8 + [True] * 4 and {r.since for r in second} == {111}
    for r in second[:8]:
        k = next(k for k in range(12) if f"m{(k * 7) % 12:02d}-2" == r.message_id)
        assert r.status == ("surfaced" if k % 2 else "contradicted") and r.checked == ["participant"] and r.failed_on == (None if k % 2 else "participant")
    # k = 0: no attachment observed; k = 1: not an attachment. Walk 2 is before the window's start, so the date fails first.
    assert {(r.failed_on, tuple(r.checked)) for r in rows if r.mailbox == 2 and r.walk == 2} == {("date", ("date",))}
    third = {int(r.history_id) - 300: r for r in rows if r.mailbox == 2 and r.walk == 3}
    assert third[0].failed_on == "has_attachment" and third[1].failed_on == "has_attachment"
    assert by[4, "m00-2"].status == "surfaced" and by[4, "m00-2"].checked == [] and "re-checked locally: [none]" in by[4, "m00-2"].reason
    told = {(r.mailbox, r.walk): r for r in recency.accounts(recency.reconcile(_feed(spark), _asked(spark))).collect()}
    assert (told[1, 2].state, told[1, 2].candidates, told[1, 2].fetched, told[1, 2].quota_units) == ("ran", 12, 8, 162) and told[1, 1].quota_units == 0 and told[4, 3].state == "rebaselined"
    assert recency.reconcile(_feed(spark).limit(0), _asked(spark)).count() == 0


def test_labels_not_observed_are_not_checked(spark):
    row = spark.createDataFrame([(1, ["a"], AT, None, None), (2, None, None, True, ["SENT"]), (3, None, None, True, ["INBOX"])], "k int, addresses array<string>, ts_us long, has_attachment boolean, labels array<string>")
    asked = recency.facts(spark.createDataFrame([(1, "label:inbox before:2026/01/01")], "query_id long, query string"), NOW, {"inbox": "INBOX"})
    got = {r.k: r.v for r in row.join(asked).select("k", recency.recheck().alias("v")).collect()}
    assert (got[1].passed, got[1].failed_on) == (False, "date") and (got[2].passed, got[2].checked, got[2].failed_on) == (False, ["label"], "label") and (got[3].passed, got[3].checked) == (True, ["label"])


@pytest.mark.parametrize("restart", [False, True])
def test_stream_equals_table(spark, tmp_path, restart):
    """Three batches, one walk each; with restart, the query ends after each and goes on from its checkpoint."""
    rows, asked = _feed(spark).filter("mailbox is not null").coalesce(1), _asked(spark)
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(w):
        rows.filter(F.col("walk") == w).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.startswith("part-") and not f.startswith("part-w"):
                os.rename(f"{folder}/{f}", f"{folder}/part-w{w}-{f}")
                os.utime(f"{folder}/part-w{w}-{f}", (1_000_000 + w, 1_000_000 + w))

    def go():
        stream = recency.walked(spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(folder), asked)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        for w in (1, 2, 3):
            arrive(w)
            if restart:
                go()
        if not restart:
            go()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*recency.COLUMNS).collect())
    assert key(spark.read.parquet(out)) == key(recency.reconcile(rows, asked))
    assert read(spark, folder, FEED).isStreaming
