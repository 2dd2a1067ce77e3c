"""Answers that continue: everything that was withheld comes back, in pages that fit."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lantern.operators import answers, disclosure

ROWS = "answer int, thread_id int, rank int, message_id string, position int, band string, score int, costs array<long>, note string"


def _rows():
    rng, out = random.Random(8), []
    for a in range(25):
        for t in range(rng.randint(1, 5)):
            for p in range(rng.randint(1, 12)):
                band = rng.choice(["EVIDENCE", "EVIDENCE", "FLOOR", "FILL", "MAP"]) if a % 5 else rng.choice(["FLOOR", "EVIDENCE", "REQUESTED"])
                costs = [151] if band in ("MAP", "REQUESTED") else sorted((151 + rng.randint(0, 1500) for _ in range(2)), reverse=True) + [151]
                out.append((a, t, t, f"{a}-{t}-{p}", p, band, rng.randint(0, 3), costs, "x"))
    return out


def test_answers_turn_back(spark):
    rows = spark.createDataFrame(_rows(), ROWS)
    made, out = disclosure.degrade_rows(rows, 1500, 2000)
    made = made.cache()
    state = answers.shown(rows, made).cache()
    assert state.count() == rows.count() and state.columns[: len(rows.columns)] == rows.columns
    hits, groups = answers.records(state)
    left = state.filter("not present")
    assert hits.count() + groups.agg(F.sum("n")).first()[0] == left.count() and hits.filter("call <> concat('expand:', message_id)").count() == 0
    assert {r.cause for r in hits.collect()} == {"split_by_source", "withheld_record"}
    rng = random.Random(1)
    size = {m: rng.choice([None, 0, 3, 50, 400, 5000]) for m in sorted(r.message_id for r in hits.collect())}
    texts = spark.createDataFrame([(m, None if n is None else n // 3, n) for m, n in size.items() if n != 3], "message_id string, tokens long, chars long")
    pages = answers.expand(hits, texts, tokens=200, chars=500).cache()
    for r in answers.broken(state, made, out, pages, texts).collect():
        assert r.hits == r.reachable and (r.floor_lost, r.rises, r.vanished, r.chars_lost) == (0, 0, 0, 0)
    by: dict = {}
    for r in sorted(pages.collect(), key=lambda r: (r.answer, r.message_id, r.slice)):
        assert by.setdefault((r.answer, r.message_id), 0) == r.from_char
        by[r.answer, r.message_id] += r.n_chars
    assert all(n == (0 if size[m] in (None, 3) else size[m]) for (_, m), n in by.items()) and len(by) == hits.count()
    for r in pages.groupBy("answer", "page").agg(F.sum("n_chars").alias("c"), F.max("next_page").alias("next")).collect():
        assert r.c <= 500 and (r.next is None or r.next == r.page + 1)
    # A page that could have taken the next slice would have.
    order = sorted(pages.collect(), key=lambda r: (r.answer, r.message_id, r.slice))
    assert [r.page for r in order if r.answer == order[0].answer] == sorted(r.page for r in order if r.answer == order[0].answer)
    # What is taken from the state shows.
    lost = answers.broken(state, made, out, pages.filter("slice > 0"), texts).agg(F.sum("vanished"), F.sum("chars_lost")).first()
    assert lost[0] > 0 and lost[1] > 0


def test_refusals(spark, tmp_path):
    rows = spark.createDataFrame(_rows(), ROWS)
    made, out = disclosure.degrade_rows(rows, 1100, 1200)
    state = answers.shown(rows, made)
    got = answers.refusals(state, out).collect()
    assert {r.answer for r in got} == {r.answer for r in out.filter("not fits").collect()} and got
    floor = {r.answer: r.f for r in state.groupBy("answer").agg(F.sum(F.when(F.col("band") == "FLOOR", 151).otherwise(0)).alias("f")).collect()}
    for r in got:
        assert (r.cause == "floor") == (floor[r.answer] + disclosure.STRUCTURE > r.ceiling)
        assert (r.narrower is None) == (r.threads <= 1 and r.hits <= 1) and (r.threads <= 1 or r.narrower.startswith("thread:"))
    rows.filter("answer < 0").write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    made, out = disclosure.degrade_rows(none)
    assert answers.refusals(answers.shown(none, made), out).count() == 0
