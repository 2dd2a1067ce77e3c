"""Semantic shortlist, mechanical rank and its gates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.adapters import cut

#: Weights of the mechanical rank.
WEIGHTS = {"query_hit": 5, "unrelaxed": 4, "participant": 3, "window": 2, "concentration": 1}
SHORTLIST, MARGIN = 25, 0.05


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector; null where widths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm))


def shortlist(pool: DataFrame, query: list[float], k: int = SHORTLIST, id_col: str = "message_id", vector: str = "vector") -> DataFrame:
    """The k vectors nearest to the query, ties by id: a top-k in each task and one merge, no sort of the pool."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return pool.select(id_col, cosine(F.col(vector), q).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)


def mechanical_rank(threads: DataFrame) -> DataFrame:
    """Adds value, the weights of the true components (columns of booleans), and rank by it, then by thread_id.

    Threads are dealt by ranges of the order; a rank is the place within a range and the number of threads in ranges
    before it, so no task holds all threads. Ranges are fixed by a checkpoint, as both counts must see the same ones.
    """
    from pyspark.sql import Window as W

    value = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") * w for c, w in WEIGHTS.items()), F.lit(0))
    order = [F.desc("value"), F.col("thread_id")]
    dealt = cut(threads.withColumn("value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).drop("_n")  # a row for each range
    placed = dealt.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(before), "_range").withColumn("rank", F.col("_place") + F.col("_before")).drop("_range", "_place", "_before")


def pool(rows: DataFrame, max_threads: int = 25, max_messages: int = 300) -> DataFrame:
    """Rows (thread_id, message_id, priority) of the first threads by priority, then id, up to both caps."""
    from pyspark.sql import Window as W

    best = rows.groupBy("thread_id").agg(F.min("priority").alias("priority")).orderBy("priority", "thread_id").limit(max_threads)
    kept = rows.select("thread_id", "message_id").distinct().join(F.broadcast(best), "thread_id").orderBy("priority", "thread_id", "message_id").limit(max_messages)
    return kept.withColumn("n", F.row_number().over(W.orderBy("priority", "thread_id", "message_id")))


_built: dict[str, Callable] = {}


def built(name: str, factory: Callable[[], Callable]) -> Callable:
    if name not in _built:
        _built[name] = factory()
    return _built[name]


class Backends:
    """Named embedding and rerank functions: built once in a process, checked on every call."""

    def __init__(self):
        self.made: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}

    def add(self, name: str, factory: Callable) -> None:
        self.made[name] = factory

    def embed(self, name: str):
        factory = self.made[name]

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            return pd.Series(checked(built(name, factory), texts.fillna("").tolist()))

        return run


def checked(embed: Callable, texts: list[str]) -> list[list[float]]:
    """One finite vector of the same width for each text, or an error."""
    out = [list(map(float, v)) for v in embed(texts)]
    if len(out) != len(texts) or len({len(v) for v in out}) > 1 or not np.isfinite(np.array(out)).all():
        raise ValueError("a backend must give one finite vector of one width for each text")
    return out


def hashing_backend(width: int = 64) -> Callable:
    """Deterministic vectors of hashed words, for use without a model."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % width] += 1 if h & 1 << 20 else -1
        return out.tolist()

    return embed
