"""Release by all requirements, graphs kept by version, identity against likeness, and the second tier of ranking."""

from __future__ import annotations

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lantern.operators import identity, release, rerank

REF = "edge_id string, node_id string, connector string, principal string, scopes array<string>, capability array<string>"
GRANT = "connector string, principal string, scopes array<string>, capability array<string>"


def test_release(spark):
    refs = spark.createDataFrame([
        ("e1", "n1", "mail", "amy", ["read"], ["body"]), ("e1", "n2", "mail", "amy", ["read", "meta"], None), ("e2", "n1", "mail", "amy", ["read"], []), ("e2", "n3", "drive", "amy", ["files"], []),
        ("e3", "n4", "mail", "bob", [], None), ("e4", "n9", "mail", "amy", ["read"], []), ("e5", "n1", None, "amy", [], []), ("e7", None, "mail", "amy", [], []),
    ], REF)
    edges = spark.createDataFrame([(f"e{i}", "x") for i in range(1, 8)], "edge_id string, connector string")
    grants = [("mail", "amy", ["read"], ["body"]), ("mail", "amy", ["meta"], None), ("drive", "amy", ["files"], []), ("mail", "bob", None, None), (None, "amy", [], [])]
    reach = spark.createDataFrame([(f"n{i}",) for i in range(1, 5)] * 2, "node_id string")
    go = lambda g: {r.edge_id: r.refused_by for r in release.release(edges, refs, spark.createDataFrame(g, GRANT), reach).collect()}
    assert go(grants) == {"e1": None, "e2": None, "e3": None, "e4": "n9", "e5": "amy", "e6": "none", "e7": ""}
    # Revoking one scope removes what rests on it and nothing else.
    assert {k for k, v in go([*grants[:1], *grants[2:]]).items() if v is None} == {"e2", "e3"} and {k for k, v in go(grants[:2] + grants[3:]).items() if v is None} == {"e1", "e3"}
    need = {(r.edge_id, r.connector): (r.scopes, r.capability, r.applies_to) for r in release.requirements(refs).collect()}
    assert need["e1", "mail"] == (["meta", "read"], ["body"], ["n1", "n2"]) and len({r.digest for r in release.requirements(refs).filter("edge_id in ('e2', 'e4') and connector = 'mail'").collect()}) == 1
    out = release.omissions(release.release(edges, refs, spark.createDataFrame(grants[2:], GRANT), reach), refs)
    assert {r.connector: r.n for r in out.filter("connector is not null").collect()} == {"mail": 4, "drive": 1} and release.release(edges.limit(0), refs, spark.createDataFrame(grants, GRANT), reach).count() == 0


def test_release_reads_references_once(spark, tmp_path):
    """However many requirements there are, the references are read and exploded no more than once; odd grants hold nothing by accident."""
    rows = [("e1", "n1", "mail", "amy", ["a", None], []), ("e2", "n1", "mail", "amy", None, None), ("e3", "n1", "mail", "amy", ["b", "a"], ["c"]), ("e3", "n2", "mail", None, [], []), ("e4", "n1", "crm", "amy", ["a"], [])]
    spark.createDataFrame(rows, REF).write.parquet(str(tmp_path / "refs"))
    refs, edges = spark.read.parquet(str(tmp_path / "refs")), spark.createDataFrame([(f"e{i}",) for i in range(1, 6)], "edge_id string")
    grants = spark.createDataFrame([("mail", "amy", ["a", None], ["c"]), ("mail", "amy", ["b"], None), ("mail", None, ["a"], [])], GRANT)
    out = release.release(edges, refs, grants, spark.createDataFrame([("n1",), ("n1",)], "node_id string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [edge_id") == 1 and "Generate" not in plan
    assert {r.edge_id: r.refused_by for r in out.collect()} == {"e1": "mail/amy", "e2": None, "e3": "mail", "e4": "crm/amy", "e5": "none"}


def test_graph_store(spark, tmp_path):
    store, t0 = release.GraphStore(str(tmp_path / "g"), parts=8), datetime(2026, 3, 1, 12)
    rows = lambda ids, at, v: spark.createDataFrame([(i, at, f"{v}-{i}-{k}") for i in ids for k in range(2)], "query_id string, built_at timestamp, node_id string")
    asked = spark.createDataFrame([(q,) for q in "abcdz"], "query_id string")
    see = lambda now: {(r.query_id, r.node_id, r.version) for r in store.get(spark, rows("a", t0, 0).schema, asked, now).collect()}
    assert see(t0) == set()
    store.put(rows("abcd", t0, 1), t0)
    part = {r.query_id: r.part for r in asked.select("query_id", store._part().alias("part")).collect()}
    before = {p: sorted(glob.glob(f"{store.path}/part={p}/*.parquet")) for p in part.values()}
    store.put(rows("b", t0 + timedelta(minutes=5), 2), t0 + timedelta(minutes=5))
    assert see(t0 + timedelta(minutes=6)) == {(q, f"1-{q}-{k}", 1) for q in "acd" for k in range(2)} | {("b", f"2-b-{k}", 2) for k in range(2)}
    after = {p: sorted(glob.glob(f"{store.path}/part={p}/*.parquet")) for p in part.values()}
    assert {p for p in before if before[p] != after[p]} == {part["b"]} and os.path.isdir(store.path)
    # Gone and never there look alike.
    assert {q for q, _, _ in see(t0 + timedelta(minutes=10))} == {"b"} and see(t0 + timedelta(minutes=15)) == set()


def test_identity(spark):
    keys = [(f"n{i}", "mail", "address", f"a{i // 2}") for i in range(8)] + [(f"n{i}", "crm", "id", f"c{(i + 1) // 2}") for i in range(8)] + [("p", "mail", "address", "x"), ("q", "crm", "address", "x"), ("r", "mail", "address", None), (None, "mail", "address", "x")]
    keys += [(f"h{i}", "mail", "list", "all") for i in range(50)]
    got = identity.entities(spark.createDataFrame(keys, "node_id string, connector string, kind string, value string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.entity_id, set()).add(r.node_id)
    # A chain of shared keys is one entity; equal values of different connectors are not equal keys; a row without a value has none.
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [{f"n{i}" for i in range(8)}, {"p"}, {"q"}, {f"h{i}" for i in range(50)}]))
    again = identity.entities(spark.createDataFrame(keys[::-1], "node_id string, connector string, kind string, value string")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got)) and all(r.entity_id.startswith("entity/") for r in got)
    names = spark.createDataFrame([("e1", "Amy Smith"), ("e2", "amy  smith."), ("e2", "A. Smith"), ("e3", "Amy-Smith"), ("e4", ""), ("e5", None), *[(f"x{i}", "info") for i in range(9)]], "entity_id string, name string")
    pairs, common = identity.candidates(names, common=5)
    assert sorted((r.left, r.right, r.confidence, r.status) for r in pairs.collect()) == [("e1", "e2", 0.3333, "candidate"), ("e1", "e3", 0.3333, "candidate"), ("e2", "e3", 0.3333, "candidate")]
    assert [tuple(r) for r in common.collect()] == [("info", 9)]


def test_rerank(spark):
    def model():
        def run(query, texts):
            if query == "breaks":
                raise RuntimeError("no memory")
            return [float("nan")] * len(texts) if query == "nan" else [1.0] * (len(texts) - 1) if query == "short" else [float(len(t)) for t in texts]

        return run

    texts = {"a": "x", "b": "xxx", "c": "xx"}
    pairs = [(i, q, f"{t}{k}", t, texts[t] * (k + 1)) for i, q in enumerate(["fine", "breaks", "nan", "short", "one without a text", "alone"]) for t in texts for k in range(2) if not (q == "alone" and t != "a")]
    pairs = [(*p[:4], None if p[1] == "one without a text" and p[3] == "b" else p[4]) for p in pairs]
    df = spark.createDataFrame(pairs, "query_id long, query string, message_id string, thread_id string, text string")
    out = rerank.scored(df, "test", model)
    rows = out.collect()
    assert {r.query_id for r in rows if r.error} == {1, 2, 3} and all((r.score is None) == bool(r.error) for r in rows) and sum(r.query_id == 4 for r in rows) == 4
    mechanical = spark.createDataFrame([(i, t, k) for i in range(5) for k, t in enumerate("abc", 1)] + [(5, "a", 1)], "query_id long, thread_id string, rank int")
    order = {}
    for r in sorted(rerank.reordered(mechanical, out).collect(), key=lambda r: (r.query_id, r.final_rank)):
        order[r.query_id] = order.get(r.query_id, "") + r.thread_id
    assert order == {0: "bca", 1: "abc", 2: "abc", 3: "abc", 4: "abc", 5: "a"}
    facts = [(i, False, None, 5, 0.5, 2, None, None, i != 3) for i in range(6)]
    queries = spark.createDataFrame(facts, "query_id long, names_id boolean, branch string, hits int, coverage double, threads int, best double, second double, semantic boolean").withColumn("names_id", F.col("query_id") == 4)
    told = {r.query_id: (r.state, r.pairs) for r in rerank.states(queries, mechanical, out).collect()}
    assert told == {0: ("reranked", 6), 1: ("unavailable", 6), 2: ("unavailable", 6), 3: ("mechanical_only", 0), 4: ("not_applicable", 0), 5: ("no_candidates", 0)}
    calm = queries.withColumn("coverage", F.lit(1.0)).withColumn("hits", F.lit(1000)).withColumn("threads", F.lit(1))
    assert rerank.states(calm, mechanical, out).filter("query_id = 0").first().state == "mechanical_only" and rerank.states(calm, mechanical, out, F.lit(True)).filter("query_id = 0").first().state == "reranked"


def test_row_text_and_contract(spark):
    row = spark.createDataFrame([(" Plan ", ["A@x", "a@x", "b@x"], "body " * 200), (None, None, None)], "subject string, people array<string>, body string")
    got = [r[0] for r in row.select(rerank.row_text(F.col("subject"), F.col("people"), F.col("body"), head=True)).collect()]
    assert got[0].startswith("Plan\na@x b@x\nbody body") and len(got[0]) < 420 and got[1] == ""
    for bad in ([1.0], [1.0, "x"], [1.0, True], (1.0, 2.0), [1.0, float("inf")]):
        with pytest.raises(ValueError):
            rerank.checked_rerank(lambda q, t, bad=bad: bad, "q", ["a", "b"])
    assert rerank.checked_rerank(lambda q, t: [1, 2.5], "q", ["a", "b"]) == [1.0, 2.5]
