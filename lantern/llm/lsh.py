"""Embedding near-dedup: p-stable hashing of normalised vectors, then exact cosines.

Quantised random projections put every vector into a bucket of each of several tables; buckets are taken apart by
label. Vectors in a bucket are compared exactly, in blocks, and a pair counts in the first table that holds it, so
degrees come out without a list of pairs. Equal vectors are compared once and weigh as many as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import components, partitions, written

COSINE = 0.93
#: Tables, projections in each, and the width of a quantum: vectors just at COSINE (0.374 apart) meet in one table
#: with a chance of about 0.8 ** 8, in one of 24 with 0.98; unrelated ones (1.41 apart) in one with 0.39 ** 8.
TABLES, PROJECTIONS, QUANTUM, SEED = 24, 8, 1.5, 10
#: Vectors of a bucket that one task compares with one another or with as many more.
BLOCK = 1024


def projections(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + dim)
    return rng.normal(size=(dim, TABLES * PROJECTIONS)), rng.uniform(0, QUANTUM, TABLES * PROJECTIONS)


def hashes(unit: np.ndarray) -> np.ndarray:
    """(vectors, TABLES) 64-bit bucket numbers."""
    a, b = projections(unit.shape[1])
    q = np.floor((unit @ a + b) / QUANTUM).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    out = np.full(q.shape[:2], unit.shape[1], np.uint64)
    for k in range(PROJECTIONS):
        out = (out ^ q[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _unit(v: list | None) -> np.ndarray | None:
    if v is None or any(x is None for x in v):
        return None
    a = np.array(v, np.float64)
    norm = np.sqrt(a @ a) if len(a) else 0.0
    return a / norm if np.isfinite(norm) and norm > 0 else None


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector of a label: cls (its least id), label, n, unit (doubles), sig (TABLES hashes)."""
    ok = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    same = ok.groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            units = [_unit(r["embedding"]) for r in rows]
            by_dim: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                if u is not None:
                    by_dim.setdefault(len(u), []).append(i)
            for at in by_dim.values():
                u = np.stack([units[i] for i in at])
                sig = hashes(u)
                cols = [pa.array([rows[i][k] for i in at], t) for k, t in (("cls", pa.int64()), ("label", pa.string()), ("n", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.tobytes() for x in u], pa.binary()), pa.array(list(sig), pa.list_(pa.int64()))], names=["cls", "label", "n", "unit", "sig"])

    return same.select("cls", F.col("label").cast("string").alias("label"), "n", "embedding").mapInArrow(run, "cls long, label string, n long, unit binary, sig array<long>")


def _compare(cosine: float):
    """Links between the rows of side 0 and those of side 1, or among side 0 where there is no side 1."""

    def links(group: pa.Table) -> pa.Table:
        cls, n, side = (group.column(c).to_numpy() for c in ("cls", "n", "side"))
        table = int(group.column("table")[0].as_py())
        unit = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(cls), -1)
        sig = np.array(group.column("sig").to_pylist(), np.int64)[:, :table] if table else np.zeros((len(cls), 0), np.int64)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        degree, root = np.zeros(len(cls), np.int64), np.arange(len(cls))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i in range(0, len(left), 256):
            rows = left[i : i + 256]
            near = unit[rows] @ unit[right].T >= cosine
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            keep = (cls[a] < cls[b]) if right is left else (a != b)
            a, b = a[keep], b[keep]
            for j in range(0, len(a), 1 << 16):
                x, y = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
                new = ~(sig[x] == sig[y]).any(1)
                np.add.at(degree, x[new], n[y[new]])
                np.add.at(degree, y[new], n[x[new]])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
        to = np.array([cls[find(i)] for i in range(len(cls))], np.int64)
        keep = (degree > 0) | (to != cls)
        return pa.table({"cls": pa.array(cls[keep]), "links": pa.array(degree[keep]), "to": pa.array(to[keep])})

    return links


def near_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors link within a label only; a null label, and a vector that is null, zero, or holds null or non-finite
    components, link with nothing, and so do vectors of different lengths. Vectors with a null id come back with no
    links and a null component. Rows that repeat a vec_id count as vectors of their own and share its component. A
    bucket is compared in blocks of BLOCK vectors: no task holds more than two, however large the bucket.
    """
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"), vectors["label"].alias("label"))
    spark = v.sparkSession
    classes = written(_classes(v), "lsh-classes")
    slots = classes.select("cls", "label", F.posexplode("sig").alias("table", "bucket"))
    sizes = slots.groupBy("label", "table", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    held = slots.join(sizes, ["label", "table", "bucket"]).withColumn("blocks", blocks)
    held = held.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # A block goes to its own task and to those that pair it with each other block.
    tasks = held.select("cls", "label", "table", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("cls", "label", "table", "bucket", F.least("block", "other").alias("b0"), F.greatest("block", "other").alias("b1"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))
    full = tasks.join(classes.select("cls", "label", "n", "unit", "sig"), ["cls", "label"])
    key = ["label", "table", "bucket", "b0", "b1"]
    found = full.repartition(partitions(spark), *key).groupBy(*key).applyInArrow(_compare(cosine), "cls long, links long, to long")
    found = written(found, "lsh-links")
    degree = found.groupBy("cls").agg(F.sum("links").alias("links"))
    part = components(found, "cls", "to")
    plain = [F.col("label").isNotNull(), F.col("vec_id").isNotNull()]
    same = v.filter(plain[0] & plain[1] & F.col("embedding").isNotNull()).groupBy("label", "embedding").agg(F.min("vec_id").alias("cls"))
    whole = v.join(same, ["label", "embedding"], "left")
    usable = classes.select("cls", F.col("label").alias("_label"), "n")
    whole = whole.withColumn("_label", F.col("label").cast("string")).join(usable, ["cls", "_label"], "left").join(degree, "cls", "left").join(part.withColumnRenamed("id", "cls"), "cls", "left")
    own = F.when(F.col("n").isNotNull(), F.coalesce("component_id", "cls")).otherwise(F.col("vec_id"))
    links = F.when(F.col("n").isNotNull(), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    out = whole.select("vec_id", links.cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
