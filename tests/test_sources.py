"""Sources: filters pushed and residual, a feed that expires, and what a connector tells."""

from __future__ import annotations

import os
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, Not, StringStartsWith

from lantern.sources import archive, connector

NOW = datetime(2026, 3, 15, 12, tzinfo=UTC)


@pytest.fixture(scope="module")
def table_path(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("table"))
    for k in range(3):
        ids = list(range(k * 100, k * 100 + 100))
        pq.write_table(pa.table({"history_id": ids, "kind": [None if i % 10 == 0 else "ab"[i % 2] for i in ids], "value": [i / 2 for i in ids], "at": pa.array([datetime(2026, 1, 1)] * 100, pa.timestamp("us"))}), f"{path}/{k}.parquet", row_group_size=25)
    with open(f"{path}/_note.txt", "w") as f:
        f.write("not a table")
    return path


def test_filters_are_pushed_or_given_back():
    r = archive.TableReader({"path": "x", "searchable": "a, b"})
    filters = [EqualTo(("a",), 1), GreaterThan(("c",), 1), In(("b",), ("x", "y")), Not(EqualTo(("a",), 2)), StringStartsWith(("b",), "x"), EqualTo(("a", "nested"), 1), EqualTo(("a",), True)]
    assert list(r.pushFilters(filters)) == [filters[k] for k in (1, 3, 4, 5, 6)] and r.tests == [("a", "==", 1), ("b", "in", ("x", "y"))]


@pytest.mark.parametrize("where", ["history_id > 120 and history_id <= 180 and kind = 'a'", "kind in ('a', 'b') and value < 30", "kind is null and history_id >= 250", "kind is not null and history_id = 41", "history_id > 1000", "kind like 'a%' or history_id = 7", "not (kind = 'a')", "true"])
def test_table_source(spark, table_path, where):
    archive.register(spark)
    df = spark.read.format("evidence_table").option("path", table_path).option("searchable", "history_id,kind").load()
    plain = spark.read.parquet(*[f"{table_path}/{k}.parquet" for k in range(3)])
    assert sorted(map(str, df.filter(where).collect())) == sorted(map(str, plain.filter(where).collect())) and df.dtypes == plain.dtypes


def test_source_without_files(spark, tmp_path):
    archive.register(spark)
    with pytest.raises(Exception, match="no Parquet file"):
        spark.read.format("evidence_table").option("path", str(tmp_path)).load().collect()
    assert archive.since(spark, str(tmp_path / "none"), 5).count() == 0


def _rows(df):
    return sorted((r.kind, r.history_id or 0, r.lost_from or 0, r.lost_to or 0) for r in df.collect())


def test_feed_in_a_batch(spark, tmp_path):
    archive.register(spark)
    path = str(tmp_path / "feed")
    feed = spark.range(1, 96).select(F.col("id").alias("history_id"), F.col("id").cast("string").alias("thread_id"), F.lit("messageAdded").alias("event_type"))
    assert sorted((r.segment[18:20], r.rows) for r in archive.write_segments(feed, path, 20).collect())[-1] == ("81", 15) and len(os.listdir(path)) == 5
    assert _rows(archive.since(spark, path, 90)) == [("change", i, 0, 0) for i in range(91, 96)]
    for first in (1, 21):
        os.remove(f"{path}/{first:020d}-{first + 19:020d}.parquet")
    assert _rows(archive.since(spark, path, 40)) == [("change", i, 0, 0) for i in range(41, 96)]
    assert _rows(archive.since(spark, path, 12)) == [("change", i, 0, 0) for i in range(41, 96)] + [("resync", 0, 13, 40)]


@pytest.mark.parametrize("restart", [True, False])
def test_feed_as_a_stream(spark, tmp_path, restart):
    """Offsets survive a restart; segments deleted before they were read come back as one declared loss."""
    archive.register(spark)
    path, out = str(tmp_path / "feed"), str(tmp_path / "out")

    def arrive(a, b):
        feed = spark.range(a, b).select(F.col("id").alias("history_id"), F.lit("t").alias("thread_id"), F.lit("labelAdded").alias("event_type"))
        archive.write_segments(feed, path, 10).collect()

    def go():
        stream = spark.readStream.format("evidence_feed").option("path", path).load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds" if not restart else "1 second").start()
        q.processAllAvailable()
        q.stop()

    arrive(1, 31)
    if restart:
        go()
    arrive(31, 61)
    for first in (1, 11, 21, 31):
        os.remove(f"{path}/{first:020d}-{first + 9:020d}.parquet")
    go()
    kept = [i for i in range(1, 61) if i > 40 or (restart and i <= 30)]
    assert _rows(spark.read.parquet(out)) == [("change", i, 0, 0) for i in kept] + [("resync", 0, 31 if restart else 1, 40)]


def test_connector(spark):
    can = connector.Capabilities("mail", search_operators=("from", "after", "rfc822msgid"))
    n = connector.translate(connector.Facts("when was it", ("alpha",), ("a b", 'say "hi"'), ("c d",), ("amy",), ("ops",), "2026/01/01", "2026/02/01", ("<x@y>",)), can)
    assert n.query == '"a b" -"c d" alpha from:amy after:2026/01/01 rfc822msgid:<x@y>' and n.unrepresentable == ('phrase:say "hi"', "to:ops", "before:2026/02/01")
    assert connector.translate(connector.Facts("when was it"), can).query == "when was it"
    m = spark.createDataFrame([(f"m{i}", "AB"[i % 2], i, "alpha " * 50 if i % 3 else None) for i in range(9)], "message_id string, thread_id string, position int, text string")
    got = connector.search(m, connector.Native("alpha"), NOW, 4).collect()
    assert [r.message_id for r in got] == ["m1", "m2", "m4", "m5"] and all(r.truncated for r in got)
    assert not any(r.truncated for r in connector.search(m, connector.Native("alpha"), NOW, 6).collect()) and connector.search(m, connector.Native("the"), NOW, 6).count() == 0
    refs = spark.createDataFrame([("A",), ("Z",), ("A",)], "thread_id string")
    rows = connector.containers(m, refs).collect()
    assert sorted((r.thread_id, r.message_id, r.n) for r in rows if r.message_id) == [("A", f"m{i}", 5) for i in (0, 2, 4, 6, 8)] and [(r.thread_id, r.n) for r in rows if not r.message_id] == [("Z", 0)]
    ids = spark.createDataFrame([("m0",), ("m1",), ("none",)], "message_id string")
    by = {d: {r.message_id: r for r in connector.items(m, ids, d).collect()} for d in connector.DEPTHS}
    assert by["stub"]["m1"].content is None and len(by["snippet"]["m1"].content) == 200 and len(by["body"]["m1"].content) == 300 and by["stub"]["m1"].chars == 300
    assert not by["body"]["none"].found and by["body"]["m0"].found and by["body"]["m0"].content is None
    with pytest.raises(ValueError):
        connector.items(m, ids, "all")
