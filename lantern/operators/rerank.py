"""The second tier of ranking: a cross-encoder over shortlisted pairs, which orders a query's candidates all or not at all.

The pairs of all queries go through one iterator UDF, query by query, so that a model is built once in a process. A
model that fails for a query costs that query its second tier and nothing else. Scores of some candidates say nothing about
the others, so unless every candidate of a query has one, its mechanical order stands whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.operators.ranking import SHORTLIST, built
from lantern.plans import rules

# Fixed value: characters of a body that stand for it in a pool.
BODY_HEAD = 400

SCORED = "query_id long, message_id string, thread_id string, score double, error string"
Rerank = Callable[[str, list[str]], list[float]]


def row_text(subject: Column, addresses: Column, more: Column | None = None, head: bool = False) -> Column:
    """What is embedded for a message: subject, distinct folded addresses, and the snippet or the first BODY_HEAD characters of the body;
    empty parts are left out, a line for each of the others."""
    people = F.array_join(F.array_distinct(F.transform(F.coalesce(addresses, F.array().cast("array<string>")), F.lower)), " ")
    parts = [F.trim(F.coalesce(subject, F.lit(""))), people] + ([] if more is None else [F.trim(F.substring(F.coalesce(more, F.lit("")), 1, BODY_HEAD) if head else F.coalesce(more, F.lit("")))])
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def checked_rerank(rerank: Rerank, query: str, texts: list[str]) -> list[float]:
    """One finite number for each text, or an error."""
    out = rerank(query, list(texts))
    if not isinstance(out, list) or len(out) != len(texts):
        raise ValueError(f"a backend gave {len(out) if isinstance(out, list) else type(out).__name__} scores for {len(texts)} candidates")
    if not all(isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) for x in out):
        raise ValueError("a backend gave a score that is not a finite number")
    return [float(x) for x in out]


def scored(pairs: DataFrame, name: str, factory: Callable[[], Rerank]) -> DataFrame:
    """query_id, message_id, thread_id, score, error of pairs (query_id, query, message_id, thread_id, text), SHORTLIST a query at most.

    A row without text, which has no basis for a score, is left out; so are rows beyond the shortlist, which the caller bounds. Where the
    backend fails or breaks its contract, the rows of that query carry the error and no score.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(q: pd.DataFrame) -> pd.DataFrame:
            try:
                values, error = checked_rerank(built(name, factory), q["query"].iloc[0], q["text"].tolist()), None
            except Exception as failed:  # noqa: BLE001  (a model of any make may fail in any way)
                values, error = [None] * len(q), f"{type(failed).__name__}: {failed}"
            return pd.DataFrame({"query_id": q["query_id"], "message_id": q["message_id"], "thread_id": q["thread_id"], "score": pd.Series(values, q.index, dtype=float), "error": error})

        open_ = None  # a query's rows may go on in the next batch
        for f in frames:
            f = f if open_ is None else pd.concat([open_, f], ignore_index=True)
            if not len(f):
                continue
            last = f["query_id"] == f["query_id"].iloc[-1]
            open_ = f[last]
            for _, q in f[~last].groupby("query_id", sort=False):
                yield told(q)
        if open_ is not None and len(open_):
            yield told(open_)

    known = pairs.filter("text is not null and text <> ''").select(F.col("query_id").cast("long"), "query", F.col("message_id").cast("string"), F.col("thread_id").cast("string"), "text")
    return known.repartition("query_id").sortWithinPartitions("query_id", "message_id").mapInPandas(run, SCORED)


def reordered(mechanical: DataFrame, scores: DataFrame) -> DataFrame:
    """mechanical (query_id, thread_id, rank) with best (a thread's highest score), ordering_applied, and final_rank.

    A query is ordered by best, then by thread, only if all its candidates have one and no row failed; else final_rank is rank.
    """
    best = scores.groupBy("query_id", "thread_id").agg(F.max("score").alias("best"))
    failed = scores.filter("error is not null").select("query_id", F.lit(True).alias("_failed")).distinct()
    x = mechanical.join(best, ["query_id", "thread_id"], "left").join(failed, "query_id", "left")
    of = W.partitionBy("query_id")
    applied = (F.count("best").over(of) == F.count(F.lit(1)).over(of)) & F.col("_failed").isNull()
    x = x.withColumn("ordering_applied", applied)
    again = F.row_number().over(of.orderBy(F.desc("best"), "thread_id"))
    return x.withColumn("final_rank", F.when(F.col("ordering_applied"), again).otherwise(F.col("rank"))).drop("_failed")


def states(queries: DataFrame, candidates: DataFrame, scores: DataFrame, forced: Column | None = None) -> DataFrame:
    """query_id, state, forbidden_by, signals, pairs: what the second tier did for each query.

    queries carries what rules.rerank_gate() reads, and semantic (whether a shortlist was made). no_candidates below two of them; not_applicable
    where the gate forbids; mechanical_only where it does not fire (and is not forced) or there is no shortlist; unavailable where a row
    failed or none had a text; else reranked.
    """
    n = candidates.groupBy("query_id").agg(F.countDistinct("thread_id").alias("_n"))
    s = scores.groupBy("query_id").agg(F.count(F.lit(1)).alias("pairs"), F.max(F.col("error").isNotNull()).alias("_failed"))
    x = queries.withColumn("_g", rules.rerank_gate()).join(n, "query_id", "left").join(s, "query_id", "left")
    asked = F.col("_g.fires") | (F.lit(False) if forced is None else forced)
    state = (
        F.when(F.coalesce("_n", F.lit(0)) < 2, "no_candidates")
        .when(F.col("_g.forbidden_by").isNotNull(), "not_applicable")
        .when(~asked | ~F.coalesce("semantic", F.lit(False)), "mechanical_only")
        .when(F.coalesce("_failed", F.lit(True)), "unavailable")
        .otherwise("reranked")
    )
    return x.select("query_id", state.alias("state"), F.col("_g.forbidden_by").alias("forbidden_by"), F.col("_g.signals").alias("signals"), F.when(state.isin("reranked", "unavailable"), F.coalesce("pairs", F.lit(0))).otherwise(0).alias("pairs"))


def overlap_backend() -> Rerank:
    """The share of a query's words that a text holds, for use without a model."""

    def rerank(query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(t.lower().split())) / len(wanted) if wanted else 0.0 for t in texts]

    return rerank
