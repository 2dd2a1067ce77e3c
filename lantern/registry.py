"""Where queries on the plain tables are registered, each with the SQL that gives the same rows, and SQL they share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = datetime(2024, 1, 31, tzinfo=UTC)
MSG = "m as (select conv_id || '-' || turn as message_id, conv_id as thread_id, turn as position, role as sender, text from conversations)"


def word(w: str, c: str = "text") -> str:
    return f"regexp_matches(lower({c}), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
