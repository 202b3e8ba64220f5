"""Profiles of tables: aggregate passes over a table, then judgement on its few numbers."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F, types as T

MAX_DISTINCT, SAMPLES = 50, 12
STALE_DAYS, LEAST_ROWS, SAMPLE_ABOVE = 60, 30, 5_000_000
TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    null_rate: float
    distinct: int  # -1: more than the cap
    low: object = None
    high: object = None
    samples: tuple = ()


@dataclass(frozen=True)
class Profile:
    table: str
    rows: int
    columns: tuple[Column, ...]
    approximate: bool = False

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)


@dataclass(frozen=True)
class Finding:
    table: str
    column: str
    severity: str
    message: str


def kind(t: T.DataType) -> str:
    if isinstance(t, TIMES):
        return "time"
    if isinstance(t, T.NumericType):
        return "numeric"
    return "text" if isinstance(t, (T.StringType, T.BooleanType)) else "other"


def column_stats(df: DataFrame) -> DataFrame:
    """column, rows, nulls, distinct, low, high (as text) of all plain columns, in one pass."""
    plain = [f for f in df.schema.fields if kind(f.dataType) != "other"]
    parts = []
    for f in plain:
        c = F.col(f"`{f.name}`")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count(F.when(c.isNull(), 1)).alias("nulls"),
                F.count_distinct(c).alias("distinct"),
                F.min(c).cast("string").alias("low"),
                F.max(c).cast("string").alias("high"),
            ).alias(f.name)
        )
    return df.agg(*parts).select(F.inline(F.array(*(F.col(f"`{f.name}`") for f in plain))))


def profile(df: DataFrame, table: str, max_distinct: int = MAX_DISTINCT, sample_above: int = SAMPLE_ABOVE, seed: int = 1) -> Profile:
    """One pass for counts, nulls, times and a distinct estimate; exact distinct values only of columns below the cap."""
    plain = [f for f in df.schema.fields if kind(f.dataType) != "other"]
    rows = df.count()
    approximate = rows > sample_above
    own = df.sample(fraction=sample_above / rows, seed=seed) if approximate else df
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(plain):
        c = F.col(f"`{f.name}`")
        aggs += [F.count(c).alias(f"c{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if kind(f.dataType) != "text":
            aggs += [F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
    r = own.agg(*aggs).first()
    few = [i for i, f in enumerate(plain) if r[f"d{i}"] <= 2 * max_distinct]
    exact = own.agg(*(F.sort_array(F.slice(F.collect_set(F.col(f"`{plain[i].name}`")), 1, 4 * max_distinct)).alias(f"v{i}") for i in few)).first() if few else None
    out = []
    for i, f in enumerate(plain):
        values = exact[f"v{i}"] if i in few else None
        distinct = -1 if values is None or len(values) > max_distinct else len(values)
        samples = tuple(values[:SAMPLES]) if values and kind(f.dataType) == "text" else ()
        null_rate = round(1 - r[f"c{i}"] / r["_n"], 3) if r["_n"] else 0.0
        low, high = (r[f"l{i}"], r[f"h{i}"]) if kind(f.dataType) != "text" else (None, None)
        out.append(Column(f.name, kind(f.dataType), null_rate, distinct, low, high, samples))
    return Profile(table, rows, tuple(out), approximate)


def findings(p: Profile, now: datetime, stale_days: int = STALE_DAYS) -> list[Finding]:
    out = []
    for c in p.columns:
        if p.rows and c.null_rate == 1:
            out.append(Finding(p.table, c.name, "high", "always null"))
        elif c.null_rate >= 0.5:
            out.append(Finding(p.table, c.name, "medium", f"{c.null_rate:.1%} null"))
        elif c.distinct == 1 and not p.approximate and p.rows > 1:
            out.append(Finding(p.table, c.name, "low", "one value only"))
        if c.kind == "time" and c.high is not None and p.rows >= LEAST_ROWS:
            last = c.high if isinstance(c.high, datetime) else datetime.combine(c.high, datetime.min.time())
            if now - last.replace(tzinfo=None) > timedelta(days=stale_days):
                out.append(Finding(p.table, c.name, "medium", f"nothing after {last:%Y-%m-%d}"))
    return out


def cadence(low: datetime, high: datetime, periods: int, floor: float = 20.0, default: float = 30.0) -> float:
    """Days between periods."""
    if periods < 2:
        return default
    return max(floor, (high - low).total_seconds() / 86400 / (periods - 1))


def segment_gaps(df: DataFrame, time: str, segment: str, cadence_days: float = 30.0, periods: int = 2, least: int = 3) -> DataFrame:
    """segment, last, rows, days_behind of segments that stop two periods or more before the table does."""
    per = df.where(F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("segment")).agg(F.to_date(F.max(time)).alias("last"), F.count(F.lit(1)).alias("rows"))
    whole = df.agg(F.to_date(F.max(time)).alias("_end"))
    out = per.where(F.col("rows") >= least).join(F.broadcast(whole))  # one row
    return out.withColumn("days_behind", F.datediff("_end", "last")).where(F.col("days_behind") >= periods * cadence_days).drop("_end")


def segment_like(name: str, k: str, distinct: int) -> bool:
    return 2 <= distinct <= 24 and (k == "text" or name.lower().endswith(("_id", "_no", "_code", "_key")))


def code_stats(df: DataFrame) -> DataFrame:
    """column, distinct, low, high of whole-number columns, in one pass."""
    own = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    parts = [F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("distinct"), F.min(c).cast("long").alias("low"), F.max(c).cast("long").alias("high")).alias(c) for c in own]
    return df.agg(*parts).select(F.inline(F.array(*own)))


def is_code(distinct: int, low: int, high: int) -> bool:
    """2 to 24 values that aren't a dense run from 0 or 1."""
    return 2 <= distinct <= 24 and not (low <= 1 and high - low + 1 == distinct)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """total and orphans: child rows whose key isn't null, and of these those without a parent."""
    own = child.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    known = parent.select(F.col(parent_key).alias("_p")).distinct()
    return own.join(known, F.col("_k") == F.col("_p"), "left").agg(F.count("_k").alias("total"), F.count(F.when(F.col("_p").isNull(), 1)).alias("orphans"))


def shared_end(profiles: list[Profile]) -> object:
    """The day on which most tables stop."""
    days = [str(c.high)[:10] for p in profiles for c in p.columns if c.kind == "time" and c.high is not None]
    return max(sorted(set(days)), key=days.count) if days else None


def surveyed(tables: dict[str, DataFrame]) -> DataFrame:
    """The statistics of all columns of a database, with the table's name: one plan, whose tables are read side by side."""
    parts = [column_stats(df).select(F.lit(name).alias("table"), "*") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(survey: DataFrame) -> DataFrame:
    """By table: rows, columns, nulls in all of them, columns that are null throughout, and columns of one value."""
    rows = F.col("rows")
    return survey.groupBy("table").agg(
        F.max(rows).alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("nulls").alias("nulls"),
        F.count(F.when((rows > 0) & (F.col("nulls") == rows), 1)).alias("empty_columns"), F.count(F.when((F.col("low") == F.col("high")), 1)).alias("constant_columns"),
    )
