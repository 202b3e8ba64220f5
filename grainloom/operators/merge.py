"""Merging records of two sources, field by field."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Refused


@dataclass(frozen=True)
class Rule:
    """strategy: prefer_incoming, keep_existing, latest, max, min, longest or source_priority; alerts: changed, or range with low and high."""

    field: str
    strategy: str = ""
    alert: str | None = None
    low: float | None = None
    high: float | None = None
    required: bool = False


def choice(rule: Rule, e: Column, i: Column, e_time: Column, i_time: Column, incoming_first: bool) -> Column:
    """Whether the incoming value is taken where both differ."""
    a, b = e.try_cast("double"), i.try_cast("double")
    numbers = a.isNotNull() & b.isNotNull()
    take = {
        "prefer_incoming": F.lit(True),
        "keep_existing": F.lit(False),
        "latest": F.coalesce(i_time >= e_time, F.lit(False)),
        "max": numbers & (b > a),
        "min": numbers & (b < a),
        "longest": F.length(i) > F.length(e),
        "source_priority": F.lit(incoming_first),
        "": F.lit(False),
    }
    if rule.strategy not in take:
        raise Refused(f"field {rule.field}: unknown strategy {rule.strategy!r}")
    return F.coalesce(take[rule.strategy], F.lit(False))


def severity(rule: Rule, e: Column, i: Column) -> Column:
    if rule.strategy == "":
        return F.lit("warning")
    if rule.strategy in ("max", "min"):
        return F.when(e.try_cast("double").isNotNull() & i.try_cast("double").isNotNull(), "info").otherwise("warning")
    return F.lit("info")


def merge(existing: DataFrame, incoming: DataFrame, key: str, rules: list[Rule], time: str | None = None, priority: tuple[str, str, tuple[str, ...]] = ("existing", "incoming", ())) -> DataFrame:
    """key, the merged fields as text, and _events, an array of (field, kind, severity, message).

    priority: names of the two sources and the order of names; a name that isn't in the order comes last.
    """
    names = [r.field for r in rules]
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_key"), *(F.col(n).cast("string").alias(f"{p}_{n}") for n in names), (F.col(time) if time else F.lit(None).cast("timestamp")).alias(f"{p}_time"))
    both = side(existing, "e").join(side(incoming, "i"), F.col("e_key") == F.col("i_key"), "full")
    rank = {n: k for k, n in enumerate(priority[2])}
    first = rank.get(priority[1], len(rank)) < rank.get(priority[0], len(rank))
    fields, events = [], []
    for r in rules:
        e, i = F.nullif(F.col(f"e_{r.field}"), F.lit("")), F.nullif(F.col(f"i_{r.field}"), F.lit(""))
        conflict = F.coalesce(e != i, F.lit(False))
        take = choice(r, e, i, F.col("e_time"), F.col("i_time"), first)
        value = F.when(conflict, F.when(take, i).otherwise(e)).otherwise(F.coalesce(e, i))
        fields.append(value.alias(r.field))
        event = lambda kind, sev, text: F.struct(F.lit(r.field).alias("field"), F.lit(kind).alias("kind"), sev.alias("severity"), text.alias("message"))  # noqa: E731, B023
        events.append(F.when(conflict, event("conflict", severity(r, e, i), F.concat(F.lit(f"{r.strategy or 'no rule'}: kept "), F.when(take, "incoming").otherwise("existing")))))
        if r.required:
            events.append(F.when(value.isNull(), event("required", F.lit("error"), F.lit("missing"))))
        if r.alert == "changed":
            events.append(F.when(e.isNotNull() & ~value.eqNullSafe(e), event("alert", F.lit("warning"), F.concat(e, F.lit(" -> "), value))))
        if r.alert == "range":
            v = value.try_cast("double")
            events.append(F.when((v < r.low) | (v > r.high), event("alert", F.lit("warning"), F.concat(value, F.lit(f" is outside {r.low} to {r.high}")))))
    kind = "array<struct<field:string,kind:string,severity:string,message:string>>"
    return both.select(F.coalesce("e_key", "i_key").alias(key), *fields, F.array_compact(F.array(*events)).cast(kind).alias("_events"))


def events(merged: DataFrame, key: str) -> DataFrame:
    return merged.select(key, F.inline("_events"))
