"""Incremental landing through Structured Streaming.

A cursor is a stored value of a column: a sync takes what is after it, lands it with insert-if-absent and then moves it.
If it is cut off between the two, the rows come again and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.landing import absent, first_per_key
from ..state import StateTable

CURSORS = "source string, cursor string, rows long, note string"


def last_cursor(state: StateTable, source: str) -> str | None:
    r = state.read().where(F.col("source") == source).agg(F.max("cursor")).first()
    return r[0]


def position(rows: DataFrame, cursor: str) -> Column:
    """The cursor as text that sorts as its values do."""
    c, kind = F.col(cursor), rows.schema[cursor].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.IntegralType):  # from 0 up
        return F.lpad((c.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    if isinstance(kind, T.NumericType):
        return F.lpad((c.cast("decimal(37,10)") + F.lit("1" + "0" * 26).cast("decimal(37,10)")).cast("string"), 39, "0")
    return c.cast("string")


def sync(rows: DataFrame, source: str, cursor: str, key: list[str], target: str, state: StateTable) -> int:
    """Lands the rows after the cursor in a Parquet table; the rows it got. Ties at the cursor are read again."""
    spark = rows.sparkSession
    last = last_cursor(state, source)
    at = position(rows, cursor)
    new = rows.where(at >= last) if last is not None else rows
    n = land(new, key, target, spark)
    top = new.agg(F.max(at)).first()[0]
    if top is not None:
        state.append([(source, top, n, "")])
    return n


def tail(rows: DataFrame, source: str, cursor: str, state: StateTable) -> None:
    """Begins at the end: what is there now isn't landed by a first sync. A source that has a cursor keeps it."""
    if last_cursor(state, source) is None and (top := rows.agg(F.max(position(rows, cursor))).first()[0]) is not None:
        state.append([(source, top, 0, "tail")])


def land(new: DataFrame, key: list[str], target: str, spark: SparkSession) -> int:
    new = first_per_key(new, key)
    try:
        new = absent(new, spark.read.parquet(target), key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(target)
    new.unpersist()
    return n


def pending(rows: DataFrame, cursor: str, state: StateTable, source: str) -> int:
    """How many rows are after the last cursor."""
    last = last_cursor(state, source)
    return rows.count() if last is None else rows.where(position(rows, cursor) > last).count()


def stream_into(stream: DataFrame, key: list[str], target: str, checkpoint: str, gate: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True, interval: str = "1 second"):
    """Lands every micro-batch, after the gate, with insert-if-absent. Returns the running query."""

    def batch(df: DataFrame, _: int) -> None:
        land(gate(df) if gate else df, key, target, df.sparkSession)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Rows and value by tumbling window; rows later than `late` are left out. Times without a zone are taken as UTC."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
