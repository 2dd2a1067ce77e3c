"""Where two nested answers differ: each as rows of path and value, compared by one full outer join.

Answers are JSON. They are parsed to VARIANT and exploded level by level, one lateral join each, so that no schema has to be known
and all answers are taken apart together. What cannot be equal by nature (nonces, instants, handles) is replaced by marks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.adapters import cut

#: Levels of nesting that are taken apart; what is deeper is compared as text.
DEPTH = 32
# The marks, and the keys whose strings are instants or handles.
NONCE, INSTANT, HANDLE = "<nonce>", "<instant>", "<handle>"
INSTANTS, HANDLES = ("fetched_at", "verified_at", "observed_at"), ("map_id",)


def normalised(payload: Column, nonce: Column | None = None, instants: tuple[str, ...] = INSTANTS, handles: tuple[str, ...] = HANDLES) -> Column:
    """JSON with a nonce, wherever it stands, and the string values of the named keys replaced by marks; null without the nonce that was promised."""
    out = payload
    for keys, mark in ((instants, INSTANT), (handles, HANDLE)):
        if keys:
            out = F.regexp_replace(out, rf'("(?:{"|".join(keys)})"\s*:\s*)"(?:[^"\\]|\\.)*"', f'$1"{mark}"')
    if nonce is not None:
        out = F.when(nonce.isNotNull() & (nonce != ""), F.replace(out, nonce, F.lit(NONCE)))
    return out


def leaves(answers: DataFrame, payload: str = "payload", depth: int = DEPTH) -> DataFrame:
    """id, path, value of every leaf of answers (id, payload: JSON): scalars as text, empty objects and arrays as '{}' and '[]'.

    JSON that cannot be read is one leaf '$' with its text; a null payload has no leaf. Keys are quoted in paths where they are not plain.
    """
    tvf = answers.sparkSession.tvf
    read = F.try_parse_json(F.col(payload))
    whole = answers.filter(F.col(payload).isNotNull())
    rows = whole.filter(read.isNotNull()).select("id", F.lit("$").alias("path"), read.alias("v"))
    out = [whole.filter(read.isNull()).select("id", F.lit("$").alias("path"), F.col(payload).alias("value"))]
    for level in range(depth):
        kind = F.schema_of_variant("v")
        text = F.col("v").cast("string")
        nested = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~text.isin("{}", "[]")
        rows = cut(rows.withColumn("nested", nested & F.lit(level < depth - 1)))
        out.append(rows.filter("not nested").select("id", "path", F.coalesce(F.col("v").cast("string"), F.lit("null")).alias("value")))
        rows = rows.filter("nested").select("id", "path", "v")
        if rows.isEmpty():
            break
        inner = tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "inner")
        plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("['"), "key", F.lit("']")))
        rows = rows.lateralJoin(inner).select("id", F.concat("path", name).alias("path"), F.col("inner").alias("v"))
    first, *others = out
    for o in others:
        first = first.unionByName(o)
    return first


def compare(left: DataFrame, right: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, path, left_value, right_value where two sets of answers (id, payload) differ; a side that lacks a path has null there."""
    a, b = leaves(left, depth=depth).withColumnRenamed("value", "left_value"), leaves(right, depth=depth).withColumnRenamed("value", "right_value")
    return a.join(b, ["id", "path"], "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value"))).select("id", "path", "left_value", "right_value")


def verdicts(ids: DataFrame, differences: DataFrame) -> DataFrame:
    """id, differences (n), equivalent for each of ids."""
    n = differences.groupBy("id").agg(F.count(F.lit(1)).alias("differences"))
    return ids.select("id").join(n, "id", "left").select("id", F.coalesce("differences", F.lit(0)).alias("differences"), F.col("differences").isNull().alias("equivalent"))


def paired_offers(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, tool, subject, state of the calls that two answers offer (id, tool, subject, evidence: array): both with equal evidence, differs, left_only, right_only."""
    a, b = left.select("id", "tool", "subject", F.array_sort(F.array_distinct("evidence")).alias("_a"), F.lit(True).alias("_l")), right.select("id", "tool", "subject", F.array_sort(F.array_distinct("evidence")).alias("_b"), F.lit(True).alias("_r"))
    j = a.join(b, ["id", "tool", "subject"], "full_outer")
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return j.select("id", "tool", "subject", state.alias("state"))
