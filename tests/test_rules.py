"""Bodies, rules, handles, stated assertions and the disclosure ladder, against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import hmac
import json
import random
from base64 import urlsafe_b64encode
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lantern.functions import body
from lantern.operators import disclosure, evaluation, handles, stated, structure
from lantern.plans import ladder, rules
from lantern.plans.query import analyse

NOW = datetime(2026, 3, 15, 12, tzinfo=UTC)

BODIES = {
    "plain": ("just words\nand more", ["original", "original"]),
    "empty": ("", ["original"]),
    "marks": ("Yes.\n> a\n\n> b\n\nAlso this.\n> c", ["original", "quoted", "quoted", "quoted", "original", "original", "quoted"]),
    "forward": ("See below\n----- Original Message -----\nold text\nThanks,\nBob", ["original", "forwarded", "uncertain", "uncertain", "uncertain"]),
    "header": ("ok\nFrom: a@x.example\nSent: today\nhello", ["original", "quoted", "quoted", "uncertain"]),
    "one_field": ("To: whoever reads this\nhello", ["original", "original"]),
    "unmarked": ("ok\nAnn Lee <ann@x.example> wrote:\nold", ["original", "quoted", "uncertain"]),
    "dangling": ("ok\nAnn Lee <ann@x.example> wrote:\n", ["original", "original", "original"]),
    "i_wrote": ("On 25 August 2026 I told bob@x.example what he wrote:\n> x", ["original", "quoted"]),
    "monday": ("x\nOn Mon, 25 August 2026 at 10:00, Ann <ann@x.example> wrote:\n> x", ["original", "quoted", "quoted"]),
    "delimiter": ("text\n-- \nAnn\n1 555", ["original", "signature", "signature", "signature"]),
    "delimiter_first": ("-- \nAnn", ["original", "original"]),
    "sign_off": ("text\nBest regards,\nAnn", ["original", "signature", "signature"]),
    "sign_off_long": ("text\nThanks,\n" + "word " * 20, ["original", "original", "original"]),
    "reply_above_signature": ("text\n> q\nThanks\nAnn", ["original", "quoted", "signature", "signature"]),
}


def test_line_classes(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in BODIES.items()] + [("null", None)], "message_id string, text string")
    c = body.lines(df).cache()
    got = {}
    for r in c.orderBy("message_id", "line").collect():
        got.setdefault(r.message_id, []).append(r["class"])
    assert got == {k: want for k, (_, want) in BODIES.items()}
    at = {}
    for r in body.spans(c).orderBy("message_id", "start").collect():
        assert r.start == at.get(r.message_id, 0) and r.end > r.start
        at[r.message_id] = r.end
    assert at == {k: len(t) for k, (t, _) in BODIES.items() if t}
    whole = body.views(c, ("original", "quoted", "forwarded", "signature", "uncertain")).collect()
    assert {r.message_id: (r.view, r.hidden) for r in whole} == {k: (t, 0) for k, (t, _) in BODIES.items()}
    views = {r.message_id: r for r in body.views(c).collect()}
    assert views["marks"].view == "Yes.\n\nAlso this.\n" and views["i_wrote"].ambiguous == 1 and views["plain"].ambiguous == 0


def test_charsets_headers_and_trees(spark):
    rows = [(1, "café".encode(), "utf-8"), (2, "café".encode("latin-1"), "UTF-8"), (3, b"\x81", None), (4, b"ok", "x-unknown"), (5, None, "utf-8"), (6, b"", " 'ASCII' ")]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, b binary, c string").select("i", body.decode_text("b", "c").alias("t")).collect()}
    assert (got[1].text, got[1].charset, got[1].fell_back) == ("café", "utf-8", False) and (got[2].text, got[2].charset, got[2].fell_back) == ("café", "cp1252", True)
    assert got[3].charset == "latin-1" and not got[4].known and got[5].text is None and got[6].charset == "ascii"
    h = spark.createDataFrame([([("To", "a"), ("SUBJECT", "x"), ("to", "b")], "text/html; Charset='UTF-8'; x=y")], "h array<struct<name: string, value: string>>, c string")
    r = h.select(body.header_table(F.col("h")).alias("h"), body.content_charset(F.col("c")).alias("c"), body.content_charset(F.lit("text/plain")).alias("n")).first()
    assert [(e.name, e.first, e["values"], e.duplicates) for e in r.h] == [("to", "a", ["a", "b"], 1), ("subject", "x", ["x"], 0)] and (r.c, r.n) == ("UTF-8", None)
    parts = [("m", "r", None, 0, "multipart/mixed", None, None, 0, None), ("m", "z", "r", 9, "text/html", None, None, 5, "<p>")]
    parts += [("m", f"p{k}", "r" if k == 0 else f"p{k - 1}", k + 1, "multipart/x", None, None, 0, None) for k in range(13)] + [("m", "deep", "p12", 50, "text/plain", None, None, 1, "never")]
    parts += [("many", "r", None, 0, "multipart/mixed", None, None, 0, None)] + [("many", f"c{k}", "r", k + 1, "text/plain", "f​.txt" if k < 2 else None, None, 1, " " if k == 2 else "t") for k in range(70)]
    df = spark.createDataFrame(parts, "message_id string, part_id string, parent_id string, place int, mime_type string, filename string, attachment_id string, size long, data string")
    b = {r.message_id: r for r in body.select_body(body.trees(df)).collect()}
    assert b["m"].body.part_id == "z" and b["m"].past_depth == 1 and b["m"].past_count == 0
    assert b["many"].body.part_id == "c3" and b["many"].past_count == 7 and [a.filename for a in b["many"].attachments] == ["f.txt", "f.txt"] and len(b["many"].unused) == 59


def test_cycles_in_long_threads(spark):
    n = 3000
    rows = [("chain", f"{k:05}", f"{k - 1:05}" if k else None) for k in range(n)] + [("zig", f"{k * 7919 % n:05}", f"{(k - 1) * 7919 % n:05}" if k else None) for k in range(n)]
    rows += [("loop", f"{k:03}", f"{(k + 1) % 7:03}") for k in range(7)] + [("loop", "in", "003"), ("self", "a", "a"), ("self", "b", "a"), ("pair", "x", "y"), ("pair", "y", "x")]
    links = spark.createDataFrame([(*r, "IN_REPLY_TO", None) for r in rows], "thread_id string, message_id string, parent_id string, linkage string, evidence string")
    cut = {(r.thread_id, r.message_id) for r in structure.refuse_cycles(links).filter("linkage = 'REPLY_CYCLE'").collect()}
    assert cut == {("loop", f"{k:03}") for k in range(7)} | {("self", "a"), ("pair", "x"), ("pair", "y")}


def test_handles(spark):
    key = b"k" * 70
    df = spark.range(1).select(F.lit("Grüße").alias("t"))
    want = hmac.new(key, "Grüße".encode(), hashlib.sha256).digest()
    assert bytes(df.select(handles.hmac_sha256(key, F.col("t"))).first()[0]) == want
    assert df.select(handles.base64url(F.lit(want))).first()[0] == urlsafe_b64encode(want).rstrip(b"=").decode()
    texts = ["plain", 'a"b\\c\n\r\t\x08\x0c', "\x00\x1f\x7f", "é€😀", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(handles.json_chars(F.col("t"))).collect()]
    assert got == [None if t is None else len(json.dumps(t)) - 2 for t in texts]
    nonce = "mw-0123456789abcdef"
    f = spark.createDataFrame([("a\nb",), (f"x {nonce}>>> y",), ("",)], "t string").select(handles.fence(F.lit(nonce), F.col("t")).alias("f")).select("f", handles.unfenced(F.col("f"))).collect()
    assert [tuple(r) for r in f] == [(f"<<<{nonce} a\nb {nonce}>>>", "a\nb"), (None, None), (f"<<<{nonce}  {nonce}>>>", "")]
    parts = dict.fromkeys(handles.KEY, F.lit("x"))
    keys = df.select(handles.cache_key(**parts), handles.cache_key(**parts | {"principal": F.lit("")}), handles.cache_key(**parts | {"kind": F.lit("vector"), "model_id": F.lit(None).cast("string")})).first()
    assert keys[0] == hashlib.sha256(json.dumps(dict.fromkeys(handles.KEY, "x"), sort_keys=True).encode()).hexdigest() and keys[1] is keys[2] is None
    bad = spark.createDataFrame([("",), ("a.b",), ("no dot",), (None,)], "h string").select(handles.verify(F.col("h"), key, 1, F.lit("a"), F.lit(0)))
    assert [r[0] for r in bad.collect()] == ["handle_invalid"] * 4


def test_stated_assertions(spark):
    rows = [
        ("a", 0, "Budget Alpha is here."), ("b", 1, "This replaces the Budget Alpha."), ("c", 2, "This does not replace it. It replaces Budget Alpha?"), ("d", 3, "Perhaps this withdraws Budget Alpha."),
        ("e", 4, "It supersedes the previous version"), ("f", 5, "Memo 12 stands.\nRevoking memo 12\nnext"), ("g", 6, "Memo 77 here. Memo 77 replaces nothing of ours."), ("h", 7, None),
    ]
    m = spark.createDataFrame([(i, "T", p, t) for i, p, t in rows], "message_id string, scope string, position int, text string")
    got = {(r.message_id, r.verb): (r.refused, r.target, r.start) for r in stated.check(m).collect()}
    assert got["b", "replaces"][0] == "target"  # c and d hold its words as well
    assert got["c", "replaces"][0] == got["d", "withdraws"][0] == got["g", "replaces"][0] == "clause" and got["e", "supersedes"][0] == "target"
    assert got["f", "revoking"] == ("target", None, 16) and ("h", "replaces") not in got
    two = m.filter("message_id in ('a', 'b')")
    r = stated.check(two).first()
    assert (r.target, r.refused, r.reference) == ("a", None, "Budget Alpha") and [tuple(e) for e in stated.edges(stated.check(two)).collect()] == [("b", "a", "supersedes")]
    assert {r.message_id: r.superseded for r in stated.newest_named(stated.check(two), two).collect()} == {"a": True, "b": False}
    quoted = two.withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.lit(99).alias("end"), F.lit("quoted").alias("class"))))
    assert stated.check(quoted).first().refused == "quotation" and stated.check(two, "de").first().refused == "language"


@pytest.mark.parametrize("q,ok", [("", False), ('""', False), ("from:", False), ("in:anywhere", False), ("in:spam -x", False), ("in:spam x", True), ("alpha", True), ("-alpha", True), ("​", False)])
def test_probes(q, ok):
    assert (rules.not_a_probe(q) is None) == ok


def test_declarations():
    assert rules.is_address("a@x.example") and not rules.is_address("a@x") and not rules.is_address("a b@x.example") and not rules.is_address("@x.example")
    assert rules.carried_form('-"Ａb"') == "-ab" and rules.operator_form("(In:Spam)") == "in:spam" and rules.content_of('subject:"a  b"') == "ab"
    p = analyse("in:spam alpha from:amy OR zzz:1", NOW)
    assert rules.region_declarations(p) == ("in:spam", "in:spam") and "participant" in rules.carried_whole("x from:Amy", p) and "region" not in rules.carried_whole("x from:Amy", p)
    d = rules.declarations(p)
    assert [x[0] for x in d.dropped] == ["OR", "zzz:1"] and "region" in d.enforced
    assert rules.declarations(analyse("last week", NOW)).enforced[-1].startswith("date widened")
    assert rules.graph_route(analyse("rfc822msgid:<a@x>", NOW)) == "OFF" and rules.graph_route(analyse("alpha", NOW)) == "STRUCTURE_ONLY" and rules.graph_route(analyse("alpha beta", NOW)) == "FULL" and rules.graph_route(analyse("a", NOW), True) == "FULL"


def test_default_region(spark):
    m = spark.createDataFrame([("a", "T", "alpha", ["INBOX"]), ("b", "T", "alpha", ["SPAM"]), ("c", "T", "alpha", ["Trash"]), ("d", "T", "alpha", None)], "message_id string, thread_id string, text string, labels array<string>")
    found = lambda q: sorted(r.message_id for r in ladder.run(m, analyse(q, NOW)).evidence.collect())
    assert found("alpha") == ["a", "d"] and found("in:anywhere alpha") == ["a", "b", "c", "d"] and found("in:spam alpha") == ["b"] and found("-in:spam alpha") == ["a", "d"]


def test_admission(spark):
    rows = [("s", 1, 0, 10), ("s", 2, 1, 5), ("s", 3, 2, 9), ("s", 4, 5, 6), ("s", 5, 6, 7), ("t", 6, 0, 1)]
    got = {r.id: r.admitted for r in rules.admitted(spark.createDataFrame(rows, "server string, id int, at int, until int")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True}


def test_evaluation(spark):
    one = [(3, 3, ["a", "b"], ["b", "a"], True, {"a": "matched", "b": "stub"}, {"a": "x", "b": "y"}, ["a"], ["d"], ["d"]), (None, 2, ["a"], ["a", "b"], True, {"a": "odd"}, {}, ["a"], ["d"], [])]
    df = spark.createDataFrame(one, "claimed int, true_length int, included array<string>, payload array<string>, more boolean, roles map<string, string>, reasons map<string, string>, evidence array<string>, derived array<string>, tagged array<string>")
    got = [tuple(r.p) for r in df.select(evaluation.partiality().alias("p")).collect()]
    assert got == [(True, True, True, True, True, True), (False, False, False, False, False, False)]
    none = spark.createDataFrame([(True, "answered")], "answerable boolean, outcome string")
    assert tuple(evaluation.outcome_rates(none).first()) == (None, None, None)
    terms = spark.createDataFrame([("Re: Alice and The Budget of Bob",)], "s string").select(evaluation.subject_terms(F.col("s"))).first()[0]
    assert terms == ["Alice", "Bob"]


def _degrade(rows, normal, overflow):
    """The steps one after another, on one answer."""
    rows = [dict(r, depth=0, out=False, run=None) for r in rows]
    price = lambda n: disclosure.RUN + disclosure.MEMBER * n
    hits = sorted((r for r in rows if r["band"] == "EVIDENCE"), key=lambda r: (-r["score"], r["position"], r["message_id"]))
    top = {r["message_id"] for r in hits[: disclosure.TOP_HITS]}
    bearing = {r["thread_id"] for r in hits}
    records, sizes = [0], []

    def cost():
        return disclosure.STRUCTURE + sum(r["costs"][r["depth"]] for r in rows if not r["out"] and r["run"] is None) + sum(price(n) for _, n in sizes) + disclosure.RECORD * records[0]

    def depths(pick):
        for r in sorted((r for r in rows if pick(r)), key=lambda r: (r["score"], -r["position"], r["message_id"])):
            while cost() > normal and r["depth"] < len(r["costs"]) - 1:
                r["depth"] += 1

    def collapse(in_hits):
        if cost() <= normal:
            return
        for t in {r["thread_id"] for r in rows}:
            if (t in bearing) != in_hits:
                continue
            stubs = sorted((r for r in rows if r["thread_id"] == t and r["depth"] == len(r["costs"]) - 1 and r["band"] != "REQUESTED"), key=lambda r: r["position"])
            run = []
            for r in [*stubs, None]:
                if run and (r is None or r["position"] != run[-1]["position"] + 1):
                    if len(run) >= 2:
                        sizes.append((t, len(run)))
                        for x in run:
                            x["run"] = len(sizes)
                    run = []
                if r:
                    run.append(r)

    depths(lambda r: r["band"] == "FILL")
    collapse(False)
    depths(lambda r: r["band"] == "EVIDENCE" and r["message_id"] not in top)
    depths(lambda r: r["band"] == "FLOOR")
    collapse(True)
    floors = {r["thread_id"] for r in rows if r["band"] == "FLOOR"}
    limit = normal
    if cost() > normal and floors and disclosure.STRUCTURE + disclosure.ROW * sum(r["run"] is None for r in rows) + sum(price(n) for _, n in sizes) > normal:
        limit = overflow
    first = min((r["rank"] for r in hits), default=None)
    for rank, t in sorted({(r["rank"], r["thread_id"]) for r in rows}, reverse=True):
        mine = [r for r in rows if r["thread_id"] == t]
        if cost() <= limit or t in floors or (t in bearing and rank == first):
            continue
        n = sum(r["band"] == "EVIDENCE" for r in mine)
        worth = sum(r["costs"][r["depth"]] for r in mine if r["run"] is None) + sum(price(k) for u, k in sizes if u == t) - disclosure.RECORD * n
        if worth > 0:
            for r in mine:
                r["out"] = True
            sizes[:] = [(u, k) for u, k in sizes if u != t]
            records[0] += n
    return cost(), limit


def test_degrade_rows(spark):
    rng, rows, want = random.Random(5), [], {}
    for a in range(40):
        mine = []
        for t in range(rng.randint(1, 4)):
            for p in range(rng.randint(1, 9)):
                band = rng.choice(["EVIDENCE", "FLOOR", "FILL", "FILL", "MAP", "MAP", "REQUESTED"])
                costs = [151] if band in ("MAP", "REQUESTED") else sorted((151 + rng.randint(0, 1500) for _ in range(rng.randint(0, 2))), reverse=True) + [151]
                mine.append({"answer": a, "thread_id": t, "rank": t, "message_id": f"{t}-{p}", "position": p, "band": band, "score": rng.randint(0, 3), "costs": costs})
        # Single rows (step 8) are left to the invariants below.
        want[a] = _degrade(mine, 2500, 3500)
        rows += mine
    df = spark.createDataFrame(rows, "answer int, thread_id int, rank int, message_id string, position int, band string, score int, costs array<long>")
    made, out = disclosure.degrade_rows(df, 2500, 3500)
    withheld = {(r.answer, r.message_id) for r in made.filter("step = 8").collect()}
    floor = {(r["answer"], r["message_id"]) for r in rows if r["band"] == "FLOOR"}
    assert withheld and not withheld & floor
    for r in out.collect():
        cost, limit = want[r.answer]
        if r.last_step <= 7:
            assert r.after == cost and (r.after <= 2500 or r.ceiling == limit), (r, cost, limit)
        else:
            assert cost > limit and r.after < cost
        assert r.fits == (r.after <= r.ceiling)
    assert {r.last_step for r in out.collect()} >= {0, 1, 7, 8}
