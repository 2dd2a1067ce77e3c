"""Pages against a fold by hand, over many chunks, with rows that no page can carry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lantern.operators import paging


def _by_hand(rows, limit):
    out, views = {}, {}
    for v, p, c in rows:
        views.setdefault(v, []).append((p, max(1, c or 1)))
    for v, items in views.items():
        items.sort()
        page, i = 0, 0
        while i < len(items):
            if items[i][1] > limit:
                out[v, items[i][0]] = (page, "oversized")
                i += 1
            else:
                used = 0
                while i < len(items) and used + items[i][1] <= limit:
                    out[v, items[i][0]] = (page, "ok")
                    used, i = used + items[i][1], i + 1
            page += 1
    return out


@pytest.mark.parametrize("limit,chunk", [(10, 1), (25, 1), (7, 64), (3, 1)])
def test_pages(spark, limit, chunk):
    rng = random.Random(limit)
    rows = [(v, p * 3 - 50, rng.choice([0, 1, 2, 3, 5, 8, 13, 40, None])) for v, n in (("a", 400), ("b", 1), (None, 60), ("c", 3 * max(limit, chunk)), ("d", max(limit, chunk) + 1)) for p in range(n)]
    rows += [("ones", p, 1) for p in range(300)] + [("last", p, 1) for p in range(limit)] + [("last", 999, 99)] + [("large", p, 99) for p in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "view string, position int, chars int, page_of string")
    got = {(r.view, r.position): (r.page, r.state) for r in paging.pages(df, limit=limit, chunk=chunk).collect()}
    assert got == _by_hand(rows, limit)


def test_page_table(spark):
    df = spark.createDataFrame([("v", p, c) for p, c in enumerate([4, 4, 4, 99, 1, 10, 1])], "view string, position int, chars int")
    got = sorted(tuple(r) for r in paging.page_table(paging.pages(df, limit=10)).collect())
    assert got == [("v", 0, "ok", 0, 2, 2), ("v", 1, "ok", 2, 3, 1), ("v", 2, "oversized", 3, 4, 0), ("v", 3, "ok", 4, 5, 1), ("v", 4, "ok", 5, 6, 1), ("v", 5, "ok", 6, None, 1)]
    assert paging.pages(df.limit(0)).count() == 0


def test_one_long_view(spark):
    """No task holds the view: its chunks are bounded, and its pages are those of the closed form."""
    n = 300_000
    df = spark.range(n).select(F.lit(1).alias("view"), F.col("id").alias("position"), F.lit(100).alias("chars"))
    out = paging.pages(df)
    assert out.filter(F.col("page") != F.floor(F.col("position") / 160)).count() == 0 and out.count() == n
