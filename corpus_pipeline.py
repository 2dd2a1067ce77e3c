"""A training corpus from documents: clean, deduplicated, masked, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next.
All but the last return the columns of docs, extra ones included, whatever their names. All read whole texts, and give an
empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import bpe, jaccard, mixing, pii, toxicity
from lantern.llm.common import table, written

#: Thousandths of the tokens that the mixture wants, each document once at most.
MIX_WANTED, MIX_EPOCHS = 800, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; null and empty texts, null ids and repeated rows are scored like any other, and so stay if clean."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingle sets of similarity 0.8 or more, the one of the smallest id.

    Null ids stand behind all others, ties go by a hash of the row, and of equal rows one stays. Null, empty and blank texts
    are copies of nothing and all stay, but for rows equal in all columns.
    """
    return jaccard.keep_one(docs, size=5, percent=80)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars counted anew; null texts stay null, other values as they are."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes; null languages and sources are leaves of their own, equal ids are taken together."""
    return mixing.select(docs, MIX_WANTED, MIX_EPOCHS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids for every row; null texts count as empty."""
    return bpe.encode(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("pii", mask_pii),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
