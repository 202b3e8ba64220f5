"""Where rows go: log, JSON lines, alerts, tables, and dry runs of services that aren't here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..errors import Refused


def outside(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Rows whose number is outside [low, high]; what isn't a number is left out."""
    if column not in df.columns:
        raise Refused(f"no column {column!r}")
    v = F.col(column).try_cast("double") if dict(df.dtypes)[column] == "string" else F.col(column).cast("double")
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    return df.where(bad)


def bulk_lines(df: DataFrame, index: str) -> DataFrame:
    """Lines of a bulk request: an action and a document for each row."""
    return df.select(F.explode(F.array(F.lit(f'{{"index":{{"_index":"{index}"}}}}'), F.to_json(F.struct("*")))).alias("value"))


def sink(spec: str) -> Callable[[DataFrame], object]:
    """log, json:path, table:name, alert:column:low:high, es:index and snowflake:table; the last two only count."""
    kind, _, rest = spec.partition(":")
    if kind == "log" and not rest:
        return lambda df: df.show(truncate=False)
    if kind == "json" and rest:
        return lambda df: df.write.mode("overwrite").json(rest)
    if kind == "table" and rest:
        return lambda df: df.write.mode("append").saveAsTable(rest)
    if kind == "alert":
        parts = rest.split(":")
        if len(parts) == 3 and parts[0]:
            low, high = (float(x) if x else None for x in parts[1:])
            return lambda df: outside(df, parts[0], low, high)
    if kind == "es" and rest:
        return lambda df: bulk_lines(df, rest).count() // 2
    if kind == "snowflake" and rest:
        return lambda df: df.count()
    raise Refused(f"unknown sink {spec!r}")
