"""The engine on small fixtures: query language, ladder, structure, accounting, graph, streaming."""

from __future__ import annotations

import glob
import math
import os
from datetime import UTC, datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lantern import catalogue
from lantern.adapters import table
from lantern.functions import text as T
from lantern.operators import disclosure, evaluation, graph, ledger, ranking, structure
from lantern.plans import ladder
from lantern.plans.predicates import Compiler
from lantern.plans.query import Window, analyse, render, split, token

NOW = datetime(2026, 3, 15, 12, tzinfo=UTC)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mail(spark):
    rows = [
        ("a1", "A", "Amy Smith <amy@team.example>", ["ops@x.example"], "Budget plan", "the alpha number", ["INBOX"], datetime(2026, 3, 1)),
        ("a2", "A", "bulkops@x.example", ["amy@team.example"], "Re: Budget plan", "beta is agreed", ["INBOX"], datetime(2026, 3, 2)),
        ("b1", "B", "ops@x.example", ["amy@team.example"], None, "alpha and beta together", ["SPAM"], datetime(2026, 2, 1)),
        ("c1", "C", None, None, "x", None, None, None),
    ]
    return spark.createDataFrame(rows, "message_id string, thread_id string, sender string, to array<string>, subject string, text string, labels array<string>, ts timestamp")


def ids(df):
    return sorted(r[0] for r in df.select("message_id").collect())


@pytest.mark.parametrize("q,expected", [
    ("alpha", ["a1", "b1"]), ("alpha beta", ["b1"]), ('"alpha and"', ["b1"]), ("alpha -beta", ["a1"]), ("{alpha beta}", ["a1", "a2", "b1"]),
    ("from:ops", ["b1"]), ("from:amy", ["a1"]), ("from:smith", ["a1"]), ("to:amy@team.example", ["a2", "b1"]), ("subject:budget", ["a1", "a2"]),
    ("in:spam", ["b1"]), ("in:anywhere alpha", ["a1", "b1"]), ("after:2026/03/02", ["a2"]), ("before:2026/03/01", ["b1"]), ("newer_than:14d", ["a2"]), ("older_than:1m", ["b1"]), ("alph", []),
])
def test_predicates(mail, q, expected):
    assert ids(mail.filter(Compiler(mail, NOW).all(analyse(q, NOW).constraints))) == expected


def test_tokens_and_windows():
    assert split('a "b c" -from:"x y" {p q}') == ["a", '"b c"', '-from:"x y"', "{p q}"]
    assert render(token('-from:"x y"')) == '-from:"x y"' and token("foo:bar").kind == "unknown_operator" and token("OR").kind == "passthrough"
    assert analyse("after:2026/03/05 before:2026/03/01", NOW).window is None
    w = analyse("last week", NOW).window
    assert (w.start, w.end) == (datetime(2026, 3, 1, tzinfo=UTC), datetime(2026, 3, 10, tzinfo=UTC))
    wide = Window(datetime(2026, 1, 2, tzinfo=UTC), datetime(2026, 1, 4, tzinfo=UTC)).widened(4)
    assert (wide.start.day, wide.end.day) == (30, 7)
    assert analyse("", NOW).coverage(0) == 1.0 and analyse("zzz:1", NOW).coverage(0) == 0.0
    assert analyse('"one two three"', NOW).tier == "exact" and analyse("from:a", NOW).tier == "filtered" and analyse("alpha", NOW).tier == "weak"


def test_ladder_finds_split_terms_only_by_decomposition(mail):
    p = analyse("number agreed", NOW)
    assert ids(ladder.hits(mail, p, ladder.filtered(p)[0])) == []
    assert [r[0] for r in ladder.threads_meeting_all(mail, p).collect()] == ["A"]
    r = ladder.run(mail, p)
    assert {x.rung for x in r.probes} == {"L1", "L1b"} and ids(r.evidence) == ["a1", "a2"]
    assert ladder.filtered(analyse("in:spam", NOW)) == []
    relaxed = ladder.run(mail, analyse("from:amy beta", NOW))
    assert relaxed.stopped == "evidence by L1b" or ids(relaxed.evidence)
    assert all(any(c.kind == "region" for c in x.constraints) for x in ladder.explain(analyse("in:spam alpha from:x", NOW)))


def test_reply_links(spark):
    rows = [
        ("m1", "T", "<1@x>", None, None), ("m2", "T", "<2@x>", "<1@x>", None), ("m3", "T", "<3@x>", "", "<1@x> <2@x>"), ("m4", "T", "<3@x>", "<9@x>", None),
        ("m5", "T", "<5@x>", "<3@x>", None), ("m6", "T", "<6@x>", "<7@x>", None), ("m7", "T", "<7@x>", "<6@x>", None), ("m8", "T", None, None, None), ("m9", "T", "<10@x>", "junk", None), ("m0", "T", "<11@x>", "<6@x>", None),
    ]
    m = spark.createDataFrame(rows, "message_id string, thread_id string, rfc822_message_id string, in_reply_to string, references string")
    from pyspark.sql import functions as F

    got = {r.message_id: (r.parent_id, r.linkage) for r in structure.reply_links(m.withColumn("headers_observed", F.lit(True))).collect()}
    assert got["m2"] == ("m1", "IN_REPLY_TO") and got["m3"] == ("m2", "REFERENCES") and got["m4"] == (None, "UNRESOLVED_PARENT")
    assert got["m5"] == (None, "AMBIGUOUS_PARENT") and got["m6"] == got["m7"] == (None, "REPLY_CYCLE") and got["m0"] == ("m6", "IN_REPLY_TO")
    assert got["m8"] == (None, "NO_MESSAGE_ID") and got["m9"] == (None, "UNPARSEABLE") and got["m1"] == (None, "NO_REPLY_HEADERS")


def test_positions_segments_participants(spark, mail):
    m = spark.createDataFrame([("a", "T", 5), ("b", "T", 5), ("c", "T", 1), ("d", "U", None), ("e", "U", 3)], "message_id string, thread_id string, internal_date_ms long")
    got = {r.message_id: (r.position, r.tied) for r in structure.positions(m).collect()}
    assert got == {"a": (1, True), "b": (2, True), "c": (0, False), "d": (None, False), "e": (None, False)}
    s = spark.createDataFrame([("T", 0, 0), ("T", 1, None), ("T", 2, structure.DAY_MS), ("T", 3, structure.DAY_MS + 1)], "thread_id string, position int, internal_date_ms long")
    assert [r.segment for r in structure.segments(s).orderBy("position").collect()] == [0, 0, 1, 1]
    p = structure.participants(mail)
    assert {(r.address, r.role) for r in p.filter("message_id = 'a1'").collect()} == {("amy@team.example", "author"), ("ops@x.example", "recipient")}


def test_ledger(spark, mail):
    held = ledger.withheld(mail, mail.filter("thread_id = 'A'"))
    assert ids(held) == ["b1", "c1"]
    ledger.certify(mail, mail.filter("thread_id = 'A'"), held)
    with pytest.raises(ValueError):
        ledger.certify(mail, mail.filter("thread_id = 'B'"), held)


def test_text_functions(spark):
    assert T.fold_text("Straße  Ａ") == "strasse a" and T.normalise_text("a  b \n\n\n\nc ") == "a b\n\nc"
    assert T.visible_text("<p>a<script>x</script><b hidden>h</b><i style='display:none'>n</i>b &amp; c</p>") == "a\nb & c"
    assert T.decode_words_text("=?utf-8?q?caf=C3=A9?=") == "café"
    df = spark.createDataFrame([("Re[2]: Fwd: x", "YWI", "1Z12345E0205271688", ""), (None, "a", None, None)], "a string, b string, c string, d string")
    r = df.select(T.strip_reply_prefixes(df.a).alias("a"), T.from_base64url(df.b).alias("b"), T.identifier_kind(df.c).alias("c"), T.count_tokens(df.d).alias("d"), T.fold(df.a).alias("e")).collect()
    assert (r[0].a, bytes(r[0].b), r[0].c, r[0].d, r[0].e) == ("x", b"ab", "tracking", 0, "re[2]: fwd: x") and r[1].b is None and r[1].a is None


def test_graph(spark):
    n = spark.createDataFrame([("m1", "message", 1, 1), ("m2", "message", 2, 1), ("p", "person", None, 1), ("t", "thread", None, 1)], "node_id string, kind string, position int, revision int")
    e = spark.createDataFrame([("e1", "m1", "t"), ("e2", "m2", "p")], "edge_id string, source string, target string")
    nodes, edges = graph.prune(n, e, 3)
    assert {r[0] for r in nodes.collect()} == {"m1", "t"} and [r[0] for r in edges.collect()] == ["e1"]
    with pytest.raises(ValueError):
        graph.merge(n, e, n.selectExpr("node_id", "kind", "position", "revision + 1 as revision"), e, 10)
    now = n.selectExpr("node_id", "revision", "node_id = 'm2' as deleted")
    kept, left = graph.disclose(n, e, now, n.select("node_id"))
    assert {r[0] for r in kept.collect()} == {"m1", "t"} and [r[0] for r in left.collect()] == ["e1"]


def test_ranking_and_disclosure(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "message_id int, vector array<double>")
    assert [tuple(r) for r in ranking.shortlist(df, [2.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    with pytest.raises(ValueError):
        ranking.checked(lambda t: [[math.nan]] * len(t), ["a"])
    rows = spark.createDataFrame([("T", 0, True), ("T", 1, True), ("T", 2, False), ("T", 3, True)], "thread_id string, position int, stub boolean")
    assert [tuple(r) for r in disclosure.collapsed_runs(rows).collect()] == [("T", 0, 1, 2)]
    s = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", None)], "k string, v double")
    assert {r.k: r.p90 for r in evaluation.p90(s, "k", "v").collect()} == {"a": 9.0, "b": None}


def _rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLE:
        assert _rows(got) == _rows(duck.execute(catalogue.ORACLE[name]).df())


def test_words_of_any_script(spark):
    row = spark.createDataFrame([("café naïve STRASSE über, ΟΔΟΣ the 10.5. HTTPS://X.example/a http://y.example/b",)], "t string")
    got = row.select(T.content_tokens(F.col("t")), *(T.has_word(F.col("t"), w) for w in ("Straße", "strasse", "naïve", "na", "οδός".replace("ό", "ο"), "stras"))).first()
    assert list(got)[0][:6] == ["café", "naïve", "strasse", "über", "οδοσ", "10.5"] and list(got)[1:] == [True, True, True, False, True, False]
    nodes = row.select(F.lit("n").alias("node_id"), F.col("t").alias("text"))
    assert sorted(r.url for r in graph.link_edges(nodes, spark.createDataFrame([("http://y.example/b", "k")], "url string, node_id string")).collect()) == ["HTTPS://X.example/a", "http://y.example/b"]


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    """A worker holds a few hundred texts at once, whatever their number."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.range(2_000).coalesce(1).selectExpr("id as doc_id", "'x' as text").write.parquet(str(tmp_path / "documents.parquet"))
    size = F.pandas_udf(lambda s: s.map(lambda _: len(s)), "long")
    assert table(spark, str(tmp_path), "documents").select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 512
