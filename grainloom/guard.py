"""Limits before and at execution: statements, bytes, rows, time."""

from __future__ import annotations

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .errors import Refused, TooCostly

MAX_ROWS = 10_000
TIMEOUT_S = 30.0
#: Words that a read-only statement doesn't hold outside of quotes.
BANNED = ("insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke", "merge", "call", "execute", "attach", "copy", "vacuum")
QUOTED = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def check_read_only(sql: str) -> str:
    """The statement without what trails it; refused unless it is one SELECT or WITH."""
    bare = QUOTED.sub(" ", sql).strip().rstrip("; \t\r\n").lower()
    if not bare:
        raise Refused("empty query")
    if not re.match(r"(select|with)\b", bare):
        raise Refused("a query starts with SELECT or WITH")
    if ";" in bare:
        raise Refused("one statement at a time")
    for w in BANNED:
        if re.search(rf"\b{w}\b", bare):
            raise Refused(f"{w.upper()} is not allowed")
    return sql.strip().rstrip("; \t\r\n")


def raw_sql(spark: SparkSession, sql: str, cap: int = MAX_ROWS) -> DataFrame:
    return spark.sql(check_read_only(sql)).limit(cap + 1)


def scanned_bytes(df: DataFrame) -> int:
    """Size of what the optimised plan's relations read, after partitions are pruned, by the plan's own statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def check_bytes(df: DataFrame, ceiling: int | None) -> None:
    """Refuses before anything is run; if the size can't be told, it is refused as well."""
    if ceiling is None:
        return
    try:
        size = scanned_bytes(df)
    except Exception as e:
        raise TooCostly(f"the size of the scan can't be told: {e}") from e
    if size > ceiling:
        raise TooCostly(f"the query would read {size} bytes; the ceiling is {ceiling}")


def capped(df: DataFrame, cap: int = MAX_ROWS) -> tuple[list, bool]:
    """Rows at the edge of the API, and whether there were more."""
    rows = df.limit(cap + 1).collect()
    return rows[:cap], len(rows) > cap


@contextmanager
def time_limit(spark: SparkSession, seconds: float = TIMEOUT_S):
    """Interrupts the jobs started inside after so many seconds."""
    tag = f"limit-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(seconds, lambda: spark.interruptTag(tag))
    timer.daemon = True
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.removeTag(tag)
