"""The cache as a table, as a stream, and as a dictionary."""

from __future__ import annotations

import os
import random

import pytest

from lantern.streaming import cache

OPS = "native_id long, seq long, op string, kind string, at_us long, revision long, seen long, oldest long, complete boolean"


def _ops():
    rng, out, at = random.Random(4), [], 0
    for seq in range(900):
        at += rng.choice([1, cache.HOUR // 20, cache.HOUR // 2, cache.HOUR])
        op = rng.choice(["put"] * 6 + ["read"] * 8 + ["change"])
        revision = rng.choice([None, seq, seq - 40]) if op == "put" else None
        live = (rng.choice([None, seq - 300, seq - 30]), rng.choice([None, seq - 20]), rng.choice([True, True, False, None])) if op == "read" else (None, None, None)
        out.append((rng.choice([1, 2, 3, 4]), seq, op, rng.choice([*cache.TTL, "unknown"]) if op != "change" else None, at, revision, *live))
    return out


def _by_hand(ops):
    store, reads, drops = {}, [], []
    for n, seq, op, kind, at, revision, seen, oldest, complete in ops:
        mine = store.setdefault(n, {})
        old = lambda k, at=at, mine=mine: at - mine[k][0] >= cache.TTL.get(k, cache.SHORTEST)
        if op == "change":
            drops.append((n, seq, len(mine)))
            mine.clear()
            continue
        if op == "read":
            if kind not in mine:
                reads.append((n, seq, kind, "miss", "unstated", False, None))
            elif old(kind):
                reads.append((n, seq, kind, "expired", "unstated", False, None))
            else:
                r = mine[kind][1]
                why = "changed" if None not in (seen, r) and seen > r else "watermark_expired" if None not in (oldest, r) and oldest > r + 1 else None if complete else "inconclusive"
                reads.append((n, seq, kind, "unverified" if why else "hit", why or "unchanged", why == "watermark_expired", None if why else r))
        for k in [k for k in mine if old(k)]:
            del mine[k]
        if op == "put":
            mine[kind] = (at, revision)
    return reads, drops


def test_table(spark):
    ops = spark.createDataFrame(_ops(), OPS)
    reads, drops = _by_hand(_ops())
    assert sorted(map(str, map(tuple, cache.replay(ops).collect()))) == sorted(map(str, reads))
    assert {r[3] for r in reads} == {"hit", "miss", "expired", "unverified"} and {r[4] for r in reads} >= {"changed", "watermark_expired", "inconclusive"}
    assert sorted(map(tuple, cache.invalidated(ops).collect())) == sorted(drops)
    assert cache.replay(ops.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    """Three batches, the query ended and started again between them."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    try:
        for k in range(3):
            spark.createDataFrame(_ops()[k * 300 : k * 300 + 300][::-1], OPS).coalesce(1).write.mode("append").parquet(folder)
            stream = cache.served(spark.readStream.schema(OPS).parquet(folder))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if was is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert sorted(map(str, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(str, _by_hand(_ops())[0])) and os.path.isdir(out)
