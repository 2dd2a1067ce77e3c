"""Parents looked up by id, the scope of a pool, and where nested answers differ."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lantern.operators import equivalence, expansion


def test_probeable(spark):
    ids = {"<a@b>": True, "a@b": False, "<a b@c>": False, '<a"@b>': False, "<{a}@b>": False, "<" + "x" * 254 + ">": True, "<" + "x" * 255 + ">": False, None: False, "": False, "<a@b> ": False}
    got = spark.createDataFrame([(k,) for k in ids], "h string").select("h", expansion.probeable(F.col("h")).alias("p")).collect()
    assert {r.h: r.p for r in got} == ids


def test_lookups(spark):
    unresolved = [(1, "c0", "<p0>", 0), (1, "c9", "<p0>", 9), (1, "c1", "<p1>", 1), (1, "c2", "bad", 2), (1, "c3", "<p2>", 3), (1, "c4", "<none>", 4), (1, "c5", "<p3>", 5), (2, "x", "<p1>", 0), (2, "y", None, 1), (3, "z", "nope", 0)]
    u = spark.createDataFrame(unresolved, "query_id long, child_id string, header string, place int")
    m = spark.createDataFrame([("m0", "A", "<p0>", "<g0>"), ("m1", "A", "<p1>", None), ("m2", "B", "<p2>", None), ("m2b", "B", "<p2>", "<g1>"), ("g0", "A", "<g0>", "<gg>"), ("gg", "A", "<gg>", "<p0>"), ("m3", "C", "<p3>", None), ("o", "C", None, "<p0>")], "message_id string, thread_id string, rfc822_message_id string, parent_header string")
    got = {(r.query_id, r.header): (r.state, r.for_child_id, r.message_id) for r in expansion.looked_up(expansion.planned(u), m).collect()}
    assert got == {(1, "<p0>"): ("recovered", "c0", "m0"), (1, "<p1>"): ("recovered", "c1", "m1"), (1, "bad"): ("skipped", "c2", None), (1, "<p2>"): ("ambiguous", "c3", None), (1, "<none>"): ("absent", "c4", None), (1, "<p3>"): ("over_cap", "c5", None), (2, "<p1>"): ("recovered", "x", "m1"), (3, "nope"): ("skipped", "z", None)}
    # Further rounds: the budget is the query's, and a circle of parents ends.
    one = u.filter("query_id = 1 and header = '<p0>'").unionByName(u.filter("query_id = 2"))
    rows = sorted((r.query_id, r["round"], r.header, r.state) for r in expansion.expanded(one, m, rounds=6).collect())
    assert rows == [(1, 1, "<p0>", "recovered"), (1, 2, "<g0>", "recovered"), (1, 3, "<gg>", "recovered"), (2, 1, "<p1>", "recovered")]
    short = sorted((r["round"], r.state) for r in expansion.expanded(one.filter("query_id = 1"), m, rounds=6, cap=2).collect())
    assert short == [(1, "recovered"), (2, "recovered"), (3, "over_cap")] and expansion.expanded(u.limit(0), m, rounds=3).count() == 0


def test_pool(spark):
    day = 86_400_000_000
    m = spark.createDataFrame([("A", 5 * day), ("B", 95 * day), ("C", 99 * day), ("D", 100 * day), ("E", None)], "thread_id string, ts_us long")
    w = spark.createDataFrame([(1, None, None, 100 * day), (2, 94 * day, 96 * day, 100 * day), (3, 9 * day, 8 * day, 100 * day)], "query_id long, start_us long, end_us long, now_us long")
    touched, people = (spark.createDataFrame(r, "query_id long, thread_id string") for r in ([(1, "B"), (1, "B")], [(1, "B"), (2, "Z")]))
    got = {(r.query_id, r.thread_id): (r.priority, r.basis) for r in expansion.pool_scope(touched, people, m, w).collect()}
    assert got == {(1, "B"): (0, "touched"), (1, "C"): (2, "recency"), (2, "Z"): (1, "participant"), (2, "B"): (2, "recency")}


def _walk(x, path="$"):
    if isinstance(x, dict) and x:
        for k, v in x.items():
            yield from _walk(v, f"{path}.{k}" if k.replace("_", "a").isalnum() and not k[0].isdigit() and k.isascii() else f"{path}['{k}']")
    elif isinstance(x, list) and x:
        for i, v in enumerate(x):
            yield from _walk(v, f"{path}[{i}]")
    else:
        yield path, x if isinstance(x, str) else json.dumps(x)


def test_differences(spark):
    a = {"outcome": "answered", "sources": [{"id": "t1", "rows": [1, 2, {"depth": "stub"}]}, {"id": "t2", "rows": []}], "partial": None, "n": {"a b": True, "é": {}}}
    b = {"outcome": "answered", "sources": [{"id": "t1", "rows": [1, 3, {"depth": "body", "more": 1}]}], "partial": False, "n": {"a b": True, "é": {}}}
    left = spark.createDataFrame([(1, json.dumps(a)), (2, "[]"), (3, None), (4, "{broken"), (5, '"x"')], "id long, payload string")
    right = spark.createDataFrame([(1, json.dumps(b)), (2, "{}"), (3, "1"), (4, "{broken"), (5, '"x"')], "id long, payload string")
    got = {(r.id, r.path): r.value for r in equivalence.leaves(left).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == dict(_walk(a)) and got[4, "$"] == "{broken" and (3, "$") not in got
    out = {(r.id, r.path): (r.left_value, r.right_value) for r in equivalence.compare(left, right).collect()}
    x, y = dict(_walk(a)), dict(_walk(b))
    want = {(1, p): (x.get(p), y.get(p)) for p in x.keys() | y.keys() if x.get(p) != y.get(p)} | {(2, "$"): ("[]", "{}"), (3, "$"): (None, "1")}
    assert out == want
    told = {r.id: (r.differences, r.equivalent) for r in equivalence.verdicts(left, equivalence.compare(left, right)).collect()}
    assert told[1] == (len(want) - 2, False) and told[4] == (0, True)
    flat = {r.path: r.value for r in equivalence.leaves(left.filter("id = 1"), depth=2).collect()}
    assert json.loads(flat["$.sources"]) == a["sources"] and flat["$.outcome"] == "answered"


def test_normalised_and_offers(spark):
    raw = '{"text": "say N1 twice N1", "fetched_at": "2026-01-01", "map_id" : "a\\"b", "n": 1}'
    row = spark.createDataFrame([(raw, "N1"), (raw, None)], "p string, n string")
    got = [r[0] for r in row.select(equivalence.normalised(F.col("p"), F.col("n"))).collect()]
    assert json.loads(got[0]) == {"text": "say <nonce> twice <nonce>", "fetched_at": "<instant>", "map_id": "<handle>", "n": 1} and got[1] is None
    offer = "id long, tool string, subject string, evidence array<string>"
    a = spark.createDataFrame([(1, "expand", "t", ["x", "y"]), (1, "map", "t", ["x"]), (1, "map", "u", ["x"]), (2, "map", "u", None)], offer)
    b = spark.createDataFrame([(1, "expand", "t", ["y", "x", "x"]), (1, "map", "t", ["z"]), (2, "map", "u", None), (2, "ask", "q", [])], offer)
    assert {(r.id, r.tool, r.subject): r.state for r in equivalence.paired_offers(a, b).collect()} == {(1, "expand", "t"): "equal", (1, "map", "t"): "differs", (1, "map", "u"): "left_only", (2, "map", "u"): "equal", (2, "ask", "q"): "right_only"}
