"""Mixing sources to target weights: hierarchical budgeting, in DataFrame operations alone.

A token budget is handed down a tree of domain, language and source. At every node the children share it by their
weights; what a child cannot use goes to its siblings, and only what no child can use has been withheld above, so
shortages are made up among siblings before ancestors. A leaf takes its documents in seeded epochs: each epoch
is a new order of all its documents, and the budget cuts a prefix of that sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lantern.llm.common import checkpoint, free_names, running_totals, written

LEVELS = ("domain", "language", "source")
#: The tables of weights; what is not named has weight 1.
DOMAIN_WEIGHTS = {"0": 40, "1": 30, "2": 20, "3": 10}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
DOMAINS, SEED = 4, "lantern"
#: Of all tokens, the part that is wanted (in thousandths), and the epochs that a leaf may give at most.
WANTED, EPOCHS = 1200, 3
#: Leaves up to this many are broadcast to the documents; more are joined.
BROADCAST_LEAVES = 50_000
#: Hexadecimal digits of the order that make a bucket in running sums.
DIGITS = 3


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The number in a source's name, modulo DOMAINS; '-' without one."""
    number = F.regexp_extract(source, "([0-9]{1,9})", 1)
    return F.when(number == "", "-").otherwise((number.cast("long") % DOMAINS).cast("string"))


def _weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(column == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str], child: str) -> DataFrame:
    """Adds budget to the children (capacity, weight, parent_budget): shares by weight, none above its capacity.

    Children in order of capacity by weight: a child is full if the level that the rest could be filled to reaches its
    capacity. Those after the first that isn't share what is left. Shares are rounded down.
    """
    order = [(F.col("capacity") / F.col("weight")).asc(), F.col(child).asc_nulls_first()]
    w = W.partitionBy(*parents).orderBy(*order)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = W.partitionBy(*parents)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    n = nodes.withColumn("_used", F.sum("capacity").over(so_far) - F.col("capacity")).withColumn("_open", F.sum("weight").over(rest) - F.sum("weight").over(so_far) + F.col("weight"))
    n = n.withColumn("_left", F.greatest(F.col("parent_budget") - F.col("_used"), F.lit(0)))
    n = n.withColumn("_full", d("capacity") * d("_open") <= d("weight") * d("_left"))
    n = n.withColumn("_order", F.row_number().over(w))
    n = n.withColumn("_short", F.min(F.when(~F.col("_full"), F.struct("_order", "_left", "_open"))).over(rest))
    share = F.floor(d("weight") * F.col("_short._left") / F.col("_short._open")).cast("long")
    full = F.col("_short").isNull() | (F.col("_order") < F.col("_short._order"))
    return n.withColumn("budget", F.when(full, F.col("capacity")).otherwise(F.least(share, F.col("capacity")))).drop("_used", "_open", "_left", "_full", "_order", "_short")


def budgets(leaves: DataFrame, wanted: int, epochs: int) -> DataFrame:
    """leaves (domain, language, source, n_tokens) with their budgets, of wanted thousandths of all tokens."""
    leaf = leaves.withColumn("capacity", F.col("n_tokens") * epochs)
    language = leaf.groupBy("domain", "language").agg(F.sum("capacity").alias("capacity"))
    domain = language.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.floor(F.sum(F.col("n_tokens").cast("decimal(38,0)")) * wanted / 1000).cast("long").alias("parent_budget"))
    d = _fill(domain.crossJoin(F.broadcast(total)).withColumn("_root", F.lit(0)).withColumn("weight", _weight(F.col("domain"), DOMAIN_WEIGHTS)), ["_root"], "domain")
    up = d.select(F.col("domain").alias("_d"), F.col("budget").alias("parent_budget"))
    la = _fill(language.join(up, F.col("domain").eqNullSafe(F.col("_d"))).drop("_d").withColumn("weight", _weight(F.col("language"), LANGUAGE_WEIGHTS)), ["domain"], "language")
    up = la.select(F.col("domain").alias("_d"), F.col("language").alias("_l"), F.col("budget").alias("parent_budget"))
    on = F.col("domain").eqNullSafe(F.col("_d")) & F.col("language").eqNullSafe(F.col("_l"))
    out = _fill(leaf.join(up, on).drop("_d", "_l").withColumn("weight", F.lit(1).cast("long")), ["domain", "language"], "source")
    return out.select(*LEVELS, "n_tokens", "budget")


def _order(doc_id: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-"))).cast("binary"))


def cuts(narrow: DataFrame, wanted: int = WANTED, epochs: int = EPOCHS) -> DataFrame:
    """One row a leaf: whole epochs, and the last order key of the part of an epoch after them (null: none).

    narrow: doc_id, domain, language, source, n_tokens. Rows with equal ids stand at one place of an order and are
    taken together.
    """
    leaves = checkpoint(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n_tokens")))
    plan = budgets(leaves, wanted, epochs)
    plan = checkpoint(plan.select(*LEVELS, "budget", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens"))).otherwise(0).cast("long").alias("whole"), "n_tokens").withColumn("rest", F.col("budget") - F.col("whole") * F.col("n_tokens")))
    part = attach(narrow, plan).filter("rest > 0").withColumn("key", _order(F.col("doc_id"), F.col("whole") + 1))
    part = part.groupBy(*LEVELS, "key", "rest").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("bucket", F.substring("key", 1, DIGITS))
    placed = running_totals(part, list(LEVELS), "bucket", [F.col("key")], F.col("n_tokens"), "before")
    last = placed.filter(F.col("before") + F.col("n_tokens") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    on = [plan[c].eqNullSafe(last[c]) for c in LEVELS]
    return checkpoint(plan.join(last, on, "left").select(*[plan[c] for c in LEVELS], "budget", "whole", "last_key"))


def attach(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """docs with the columns of their leaf: broadcast while leaves are few, as counted, else joined."""
    renamed = leaves.select(*[F.col(c).alias(f"_{c}") for c in LEVELS], *[c for c in leaves.columns if c not in LEVELS and c not in docs.columns])
    if leaves.count() <= BROADCAST_LEAVES:
        renamed = F.broadcast(renamed)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LEVELS]
    return docs.join(renamed, on, "left").drop(*[f"_{c}" for c in LEVELS])


def _copies() -> Column:
    part = F.coalesce(_order(F.col("doc_id"), F.col("whole") + 1) <= F.col("last_key"), F.lit(False))
    return F.col("whole") + part.cast("long")


def narrowed(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), domain_of(docs["source"]).alias("domain"), docs["lang"].alias("language"), docs["source"].alias("source"), tokens(docs["text"]).alias("n_tokens"))


def mix(docs: DataFrame, wanted: int = WANTED, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, domain, language, source, n_tokens, copies for every document: how many times the mixture takes it.

    Texts are read once, for their token counts, and never shuffled. Null texts have no tokens; null levels are leaves
    of their own; documents without tokens ride along with their place in an order. copies is 0 for documents
    that are not taken.
    """
    narrow = written(narrowed(docs), "mix")
    out = attach(narrow, cuts(narrow, wanted, epochs))
    return out.select("doc_id", *LEVELS, "n_tokens", _copies().alias("copies"))


def select(docs: DataFrame, wanted: int, epochs: int = 1) -> DataFrame:
    """The rows of docs that the mixture takes, all columns, repeated as often as it takes them.

    Null texts and levels, repeated rows and documents without tokens count as in mix(); columns may have any names;
    an empty table gives an empty one.
    """
    narrow = written(narrowed(docs), "mix")
    cut = cuts(narrow, wanted, epochs)
    *level, whole, last, n = free_names(docs, *(f"_{c}" for c in LEVELS), "_whole", "_last", "_n")
    renamed = cut.select(*[F.col(c).alias(x) for c, x in zip((*LEVELS, "whole", "last_key"), (*level, whole, last), strict=True)])
    if cut.count() <= BROADCAST_LEAVES:
        renamed = F.broadcast(renamed)
    on = [c.eqNullSafe(renamed[x]) for c, x in zip((domain_of(docs["source"]), docs["lang"], docs["source"]), level, strict=True)]
    part = F.coalesce(_order(docs["doc_id"].cast("long"), F.col(whole) + 1) <= F.col(last), F.lit(False)).cast("long")
    taken = docs.join(renamed, on).withColumn(n, F.col(whole) + part).filter(F.col(n) > 0)
    if epochs > 1:
        taken = taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return taken.select(*docs.columns)
