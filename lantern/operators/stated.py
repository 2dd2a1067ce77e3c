"""Stated assertions: a message that says it supersedes another, checked by its words, its clause and what it points at."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The verbs, the cues that unsay a clause, the words that point at nothing in particular.
VERBS = "supersedes superseding replaces replacing withdraws withdrawing revokes revoking overrides overriding".split()
NEGATION = ("not", "no", "never", "nor", "neither", "none", "nothing", "nobody", "nowhere", "cannot", "without", "rather than", "instead of", "no longer", "decline", "declines", "declined")
HYPOTHETICAL = (
    "if", "unless", "would", "could", "should", "might", "may", "were to", "in case", "in the event", "provided that", "assuming", "suppose", "hypothetically",
    "propose", "proposes", "proposed", "proposal", "plan to", "planning to", "intend to", "going to",
)
HEDGE = ("perhaps", "maybe", "possibly", "probably", "presumably", "apparently", "seems", "seem", "appears", "appear", "i think", "i believe", "arguably", "effectively", "more or less")
OPENERS = "should shall do does did is are was were can could would will who what which when where why how".split()
GENERIC = "above attachment below copy document draft earlier email file former item last later mail message note old older one preceding previous prior recent revision thing thread update version".split()
SMALL = "the a an of our your my their its this that those".split()
POINTERS = ("it", "this", "that", "the above", "the below", "the former", "the one before")
REFERENCE_CHARS = 90
MATCH = rf"(?iU)\b(?:{'|'.join(VERBS)})\b[^.!?;\n]*"


def words(c: Column) -> Column:
    """Distinct words of a text that say something, lower case."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9']+)"), F.lit(1))), lambda w: ~w.isin(SMALL))


def nominate(messages: DataFrame) -> DataFrame:
    """message_id, scope, text, start, end, quoted, verb, reference: clauses from a verb on, as offsets into the text.

    Offsets follow from the lengths of what lies between the matches, so no Python is needed.
    """
    hits = messages.filter(F.col("text").rlike(MATCH)).select("message_id", "scope", "text", F.regexp_extract_all("text", F.lit(f"({MATCH})"), F.lit(1)).alias("q"), F.split("text", MATCH, -1).alias("gaps"))
    each = hits.select("message_id", "scope", "text", "gaps", "q", F.posexplode("q").alias("k", "quoted"))
    sizes = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    each = each.withColumn("start", sizes(F.col("gaps"), F.col("k") + 1) + sizes(F.col("q"), F.col("k"))).withColumn("end", F.col("start") + F.length("quoted"))
    verb = F.lower(F.regexp_extract("quoted", rf"(?iU)^({'|'.join(VERBS)})", 1))
    rest = F.regexp_replace(F.substr("quoted", F.length(verb) + 1), r"(?U)^\s+|\s+$", "")
    rest = F.trim(F.substring(F.regexp_replace(rest, r"(?iU)^(?:the|our|that|this|a|an|its|their)\s+", ""), 1, REFERENCE_CHARS))
    return each.select("message_id", "scope", "text", "start", "end", "quoted", verb.alias("verb"), rest.alias("reference")).filter("reference <> ''")


def clause() -> tuple[Column, Column]:
    """Start and end of the clause around text[start:end]: from the last end of a sentence or line to the next, mark included."""
    before, after = F.substr("text", F.lit(1), F.col("start")), F.substr("text", F.col("end") + 1)
    left = F.length(F.regexp_extract(before, r"(?s)^(.*[.!?;\n])", 1))
    return left, F.col("end") + F.length(F.regexp_extract(after, r"^([^.!?;\n]*[.!?;]?)", 1))


def cues(text: Column) -> Column:
    """The cues in a clause that keep it from being an assertion."""
    folded = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    found = [F.when(folded.rlike(rf"(?U)\b{re.escape(c)}\b"), f"{k}:{c}") for k, cs in (("negation", NEGATION), ("hypothetical", HYPOTHETICAL), ("hedge", HEDGE)) for c in cs]
    found.append(F.when(folded.rlike(r"(?U)\b\w+n't\b"), "negation:n't"))
    first = F.try_element_at(F.regexp_extract_all(folded, F.lit("([a-z0-9']+)"), F.lit(1)), F.lit(1))
    found.append(F.when(first.isin(OPENERS), F.concat(F.lit("interrogative:"), first)))
    found.append(F.when(folded.rlike(r"\?$"), "interrogative:?"))
    return F.array_sort(F.array_compact(F.array(*found)))


def check(messages: DataFrame, language: str = "en") -> DataFrame:
    """message_id, start, verb, reference, target, refused: each nomination of messages (message_id, scope, text, and
    optionally spans of classes), with the first gate that refuses it, or the one message of its scope that it names.

    Gates in order: span, language, quotation (a span that is not the sender's own), clause, target. A target is named if
    every word of the reference that says something is in its text; messages meet by those words, within a scope.
    """
    n = nominate(messages.select("message_id", "scope", "text"))
    n = n.withColumn("nomination", F.struct("message_id", "start"))
    left, right = clause()
    line_end = F.regexp_extract(F.substr("text", F.col("end") + 1), r"^([^\n]*)", 1)
    n = n.withColumn("clause", F.substr("text", left + 1, right - left)).withColumn("_asks", F.regexp_replace(line_end, r"\s+$", "").endswith("?"))
    n = n.withColumn("cues", F.array_union(cues(F.col("clause")), F.when(F.col("_asks"), F.array(F.lit("interrogative:?"))).otherwise(F.array().cast("array<string>"))))
    folded = F.regexp_replace(F.trim(F.regexp_replace(F.lower("reference"), r"(?U)\s+", " ")), r"""^[ .,;:"']+|[ .,;:"']+$""", "")
    n = n.withColumn("_words", words(folded))
    names = ~folded.isin(*POINTERS) & (F.size(F.array_except("_words", F.array(*map(F.lit, GENERIC)))) > 0)
    n = n.withColumn("_names", names)
    sought = n.filter("_names").select("nomination", "scope", F.col("message_id").alias("by"), F.size("_words").alias("want"), F.explode("_words").alias("word"))
    there = messages.select("scope", F.col("message_id").alias("target"), F.explode(words(F.col("text"))).alias("word")).join(sought.select("scope", "word").distinct(), ["scope", "word"], "left_semi")
    met = sought.join(there, ["scope", "word"]).filter("target <> by").groupBy("nomination", "target", "want").agg(F.count(F.lit(1)).alias("got")).filter("got = want")
    found = met.groupBy("nomination").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))
    j = n.join(found, "nomination", "left")
    own = F.lit(True)
    if "spans" in messages.columns:
        j = j.join(messages.select("message_id", "spans"), "message_id", "left")
        own = F.forall(F.filter("spans", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start"))), lambda s: s["class"] == "original")
    refused = (
        F.when(F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quoted"), "span")
        .when(F.lit(language != "en"), "language").when(~own, "quotation").when(F.size("cues") > 0, "clause").when(~F.coalesce(F.col("n") == 1, F.lit(False)), "target")
    )
    j = j.withColumn("refused", refused)
    return j.select("message_id", "start", "verb", "reference", F.when(F.col("refused").isNull(), F.col("target")).alias("target"), "refused", "cues")


def edges(checked: DataFrame) -> DataFrame:
    """source, target, relation of the assertions that all gates let pass, once for each pair."""
    return checked.filter("refused is null").select(F.col("message_id").alias("source"), "target", F.lit("supersedes").alias("relation")).distinct()


def newest_named(checked: DataFrame, messages: DataFrame) -> DataFrame:
    """message_id, superseded: whether a later message of its scope is stated to stand in its place."""
    late = edges(checked).join(messages.select(F.col("message_id").alias("source"), F.col("position").alias("at")), "source").join(messages.select(F.col("message_id").alias("target"), "position"), "target").filter("at > position")
    return messages.select("message_id").join(late.select(F.col("target").alias("message_id"), F.lit(True).alias("_s")).distinct(), "message_id", "left").select("message_id", F.coalesce("_s", F.lit(False)).alias("superseded"))
