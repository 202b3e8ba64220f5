"""Expressions that models and checks use beside Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, of the UTF-8 bytes of a text."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.length(hexes), F.lit(2))
    step = lambda h, i: ((h.bitwiseXOR(F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text.isNull(), None).when(text == "", F.lit(2166136261)).otherwise(F.aggregate(at, F.lit(2166136261).cast("long"), step))


def bucket(text: Column, n: int = 100) -> Column:
    return fnv1a(text) % n


def within(at: Column, start: Column, days: int = 0, months: int = 0) -> Column:
    """Whether a time is in the half-open window of so many months and days from start."""
    end = F.date_add(F.add_months(start, months), days)
    return (at >= start) & (at < end)


def last_days(at: Column, now: Column, n: int) -> Column:
    """Whether a time is one of the last n days, today included; later ones aren't."""
    today = F.to_date(now)
    return (F.to_date(at) > F.date_sub(today, n)) & (F.to_date(at) <= today)


def age_seconds(at: Column, now: Column) -> Column:
    """Whole seconds from at to now."""
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(at.cast("timestamp"))


def code_tail(code: Column, skip: int) -> Column:
    """A code without its first characters."""
    return F.substring(code, F.lit(skip + 1), F.length(code))


def normalised(v: Column) -> Column:
    """A vector of length 1; one of length 0 stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # as the only value of an array the size is computed once, not for each number
    return F.transform(F.array(size), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
