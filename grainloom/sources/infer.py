"""Column types by looking at all values of text columns, in one pass."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Refused

#: Date layouts that are accepted, in this order.
LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd")
KINDS = {"int": "bigint", "numeric": "decimal(38,10)", "date": "timestamp_ntz", "bool": "boolean", "text": "string"}


def as_time(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(x)) for x in LAYOUTS))


def tests(c: Column) -> dict[str, Column]:
    """Whether a value may be of a kind. Digits with leading zeros stay text."""
    padded = c.rlike("^-?0[0-9]+$")
    return {
        "int": c.rlike("^-?[0-9]{1,18}$") & ~padded,
        "numeric": c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~padded,
        "date": as_time(c).isNotNull(),
        "bool": F.lower(c).isin("true", "false", "t", "f", "yes", "no"),
    }


def infer(df: DataFrame) -> dict[str, str]:
    """The narrowest of int, numeric, date, bool and text that all non-empty values of a column have."""
    out = {}
    exprs = []
    for i, name in enumerate(df.columns):
        c = F.trim(F.col(f"`{name}`"))
        some = c.isNotNull() & (c != "")
        exprs.append(F.count(F.when(some, 1)).alias(f"n{i}"))
        exprs += [F.count(F.when(some & F.coalesce(t, F.lit(False)), 1)).alias(f"{k}{i}") for k, t in tests(c).items()]
    row = df.agg(*exprs).first() if exprs else None
    for i, name in enumerate(df.columns):
        n = row[f"n{i}"]
        out[name] = next((k for k in ("int", "numeric", "date", "bool") if n and row[f"{k}{i}"] == n), "text")
    return out


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Values that don't fit, and empty ones of columns that aren't text, are null; never 0."""

    def cast(name: str) -> Column:
        c, k = F.col(f"`{name}`"), kinds[name]
        if k == "text":
            return c.alias(name)
        some = F.when(F.trim(c) != "", F.trim(c))
        if k == "date":
            return as_time(some).cast("timestamp_ntz").alias(name)
        if k == "bool":
            return F.when(F.lower(some).isin("true", "t", "yes"), True).when(F.lower(some).isin("false", "f", "no"), False).alias(name)
        return some.try_cast(KINDS[k]).alias(name)

    return df.select(*(cast(c) for c in df.columns))


def fold(name: str) -> str:
    """A name as an identifier: letters and digits of any script in lower case, all else one underscore."""
    return re.sub(r"[\W_]+", "_", name, flags=re.UNICODE).strip("_").lower()


def folded(df: DataFrame) -> DataFrame:
    names = [fold(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice or "" in names:
        raise Refused(f"columns can't be told apart once folded: {twice or ['']}")
    return df.toDF(*names)


def date_evidence(df: DataFrame, layouts: tuple[str, ...] = ("yyyy-MM-dd", "yyyyMMdd")) -> DataFrame:
    """column, layout, filled, dates: of each text column how many values there are and how many are days of a layout, in one pass."""
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(x).alias("layout"), F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))).alias("value"))
        for c in text for x in layouts
    ]
    rows = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    day = F.when(F.length("value") == F.length("layout"), F.expr("try_to_timestamp(value, layout)"))
    return rows.groupBy("column", "layout").agg(F.count("value").alias("filled"), F.count(day).alias("dates"))


def retyped(df: DataFrame, least: float = 0.95, most_new_nulls: int = 0) -> DataFrame:
    """Text columns of which `least` or more of the values are days become dates, if no more than so many values are lost."""
    found = date_evidence(df).where((F.col("dates") >= least * F.col("filled")) & (F.col("dates") > 0) & (F.col("filled") - F.col("dates") <= most_new_nulls))
    best = {r["column"]: r["layout"] for r in found.orderBy("column", "dates").collect()}  # a row a column and layout
    return df.withColumns({c: F.expr(f"cast(try_to_timestamp(trim(`{c}`), '{x}') as date)") for c, x in best.items()}) if best else df
