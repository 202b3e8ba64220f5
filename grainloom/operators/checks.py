"""Checks against independently written SQL or published figures: conflicts, reconciliation, search for a figure, drift."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import Refused
from ..guard import check_read_only
from ..model import Model
from ..plans.graph import dimensions_for
from ..plans.planner import Resolver, plan
from ..plans.query import Filter, SemanticQuery
from .profile import Profile, cadence


@dataclass(frozen=True)
class Conflict:
    name: str
    severity: str
    description: str
    sql: str


def conflicts(spark: SparkSession, checks: list[Conflict]) -> list[tuple[str, str, int]]:
    """name, severity and number of offending rows of each check."""
    return [(c.name, c.severity, spark.sql(check_read_only(c.sql)).count()) for c in checks]


@dataclass(frozen=True)
class Case:
    """A metric with a control query (relative tolerance) or a published value (absolute tolerance)."""

    metric: str
    control: str | None = None
    value: float | None = None
    where: tuple[Filter, ...] = ()
    source: str = ""
    tol: float = 1e-6


@dataclass(frozen=True)
class Result:
    case: Case
    got: float | None
    want: float | None
    ok: bool


def reconcile(spark: SparkSession, model: Model, resolve: Resolver, cases: list[Case]) -> list[Result]:
    out = []
    for c in cases:
        got = plan(model, SemanticQuery((c.metric,), where=c.where), resolve).first()[0]
        if c.control is not None:
            want = spark.sql(check_read_only(c.control)).first()[0]
            ok = got is not None and want is not None and abs(float(got) - float(want)) <= c.tol * max(abs(float(want)), 1e-12)
        elif c.value is not None:
            want = c.value
            ok = got is not None and abs(float(got) - want) <= c.tol
        else:
            raise Refused(f"case {c.metric}: neither control nor value")
        out.append(Result(c, None if got is None else float(got), None if want is None else float(want), bool(ok)))
    return out


def verdict(model: Model, results: list[Result]) -> str:
    if not results:
        return "NOT VERIFIED"
    if any(not r.ok for r in results):
        return "FAILING"
    if {r.case.metric for r in results} < set(model.metrics):
        return "PARTIAL"
    return "VERIFIED" if any(r.case.value is not None or r.case.source for r in results) else "SELF-CONSISTENT"


#: Units after a figure.
UNITS = {"%": 1.0, "k": 1e3, "m": 1e6, "bn": 1e9, "万": 1e4, "亿": 1e8}
FIGURE = re.compile(r"^\s*([+-]?[\d,]*\.?\d+)\s*(%|k|m|bn|万|亿)?\s*$", re.I)


def figure(text: str) -> tuple[float, float]:
    """The number a text gives, and half a unit of its last digit."""
    m = FIGURE.match(text)
    if not m:
        raise Refused(f"{text!r} isn't a figure")
    digits = m[1].replace(",", "")
    unit = UNITS[(m[2] or "%").lower()]
    places = len(digits.partition(".")[2])
    return float(digits) * unit, 0.5 * 10**-places * unit


@dataclass(frozen=True)
class Match:
    metric: str
    scope: tuple[tuple[str, str], ...]
    value: float
    scale: float = 1.0


def anchor(model: Model, resolve: Resolver, metric: str, target: float, tol: float, grains: tuple[str, ...] = ("year", "quarter", "month"), groups: int = 200, queries: int = 120) -> list[Match]:
    """Where a published figure comes from: the total, periods, categories, both, then other units. The first scope with a match ends it."""
    dims = dimensions_for(model, metric)
    times = sorted(d for d in dims if model.dimensions[d].type == "time")
    kinds = sorted(dims - set(times))
    plans: list[tuple[tuple[str, ...], str | None]] = [((), None)]
    plans += [((t,), g) for t in times for g in grains]
    plans += [((c,), None) for c in kinds]
    plans += [((c, t), g) for c in kinds for t in times for g in grains]
    seen: list[tuple[tuple[tuple[str, str], ...], float]] = []
    for by, grain in plans[:queries]:
        rows = plan(model, SemanticQuery((metric,), by, time_grain=grain), resolve).limit(groups + 1).collect()
        if len(rows) > groups:
            continue
        found = []
        for r in rows:
            if r[metric] is None:
                continue
            scope = tuple((d, str(r[d])) for d in by)
            seen.append((scope, float(r[metric])))
            if abs(float(r[metric]) - target) <= tol:
                found.append(Match(metric, scope, float(r[metric])))
        if found:
            return found
    return [Match(metric, s, v, k) for k in (0.01, 100.0, 1e-4, 1e4) for s, v in seen if abs(v * k - target) <= tol]


def too_coarse(values: list[float], tol: float) -> bool:
    """More than one match and all values within the tolerance: the figure doesn't tell them apart."""
    return len(values) > 1 and max(values) - min(values) <= 2 * tol


@dataclass
class Drift:
    missing_tables: list[str] = field(default_factory=list)
    missing_columns: list[str] = field(default_factory=list)
    stale: list[str] = field(default_factory=list)
    failing: list[str] = field(default_factory=list)

    @property
    def healthy(self) -> bool:
        return not (self.missing_tables or self.missing_columns or self.stale or self.failing)


def stale(p: Profile, now: datetime, after_days: float = 60.0) -> list[str]:
    """Time columns that end longer ago than twice their cadence, and than after_days."""
    out = []
    for c in p.columns:
        if c.kind != "time" or c.high is None or p.rows < 30:
            continue
        low, high = (x if isinstance(x, datetime) else datetime.combine(x, datetime.min.time()) for x in (c.low, c.high))
        limit = max(after_days, 2 * cadence(low, high, c.distinct))
        if (now - high.replace(tzinfo=None)).total_seconds() / 86400 > limit:
            out.append(f"{p.table}.{c.name}")
    return out


def drift(model: Model, tables: dict[str, DataFrame], profiles: list[Profile], results: list[Result], now: datetime) -> Drift:
    """What no longer fits the model."""
    out = Drift()
    for e in model.entities.values():
        if e.table not in tables:
            out.missing_tables.append(e.table)
    for d in model.dimensions.values():
        t = model.entities[d.entity].table
        if t in tables and d.column not in tables[t].columns:
            out.missing_columns.append(f"{t}.{d.column}")
    out.stale = [s for p in profiles for s in stale(p, now)]
    out.failing = [r.case.metric for r in results if not r.ok]
    return out


def same_answers(got: list[tuple], want: list[tuple], tol: float = 1e-6) -> bool:
    """Order-insensitive: numbers sorted and compared, with 1 as the least scale; labels as multisets; nulls left out."""
    def parts(rows):
        flat = [v for r in rows for v in r if v is not None]
        numbers = sorted(float(v) for v in flat if isinstance(v, (int, float)) and not isinstance(v, bool))
        return numbers, sorted(str(v) for v in flat if isinstance(v, (str, bool, date, datetime)))

    (a, x), (b, y) = parts(got), parts(want)
    return x == y and len(a) == len(b) and all(abs(i - j) <= tol * max(1.0, abs(j)) for i, j in zip(a, b, strict=True))


def graded(cases: DataFrame) -> DataFrame:
    """Of (category, want, got): cases, right and wrong ones, refusals, and the share that is right, by category."""
    ok = F.col("want").eqNullSafe(F.col("got"))
    return cases.groupBy("category").agg(
        F.count(F.lit(1)).alias("cases"), F.count(F.when(ok, 1)).alias("right"), F.count(F.when(~ok & F.col("got").isNotNull(), 1)).alias("wrong"),
        F.count(F.when(~ok & F.col("got").isNull(), 1)).alias("refused"), F.avg(ok.cast("double")).alias("accuracy"),
    )


def confusion(cases: DataFrame) -> DataFrame:
    """How often each wanted answer was given as which; a refusal is a null."""
    return cases.groupBy("want", "got").agg(F.count(F.lit(1)).alias("cases"))


def category_floors(graded: DataFrame, floors: dict[str, float]) -> list[str]:
    """Categories of (category, ok) whose share of right answers is below its floor."""
    rows = graded.groupBy("category").agg(F.avg(F.col("ok").cast("double")).alias("share")).collect()
    return sorted(r["category"] for r in rows if r["share"] < floors.get(r["category"], floors.get("*", 0.0)))


#: What a question is graded on, each a column of what was wanted and of what was got.
AXES = ("metrics", "group_by", "filters", "grain", "answer")


def axes(cases: DataFrame) -> DataFrame:
    """Of (id, want_<axis>, got_<axis>): whether each axis is right, and all. Lists are compared as sets; two nulls are equal."""

    def part(c: str):
        return F.array_sort(F.array_distinct(c)) if cases.schema[c].dataType.typeName() == "array" else F.col(c)

    ok = {a: part(f"want_{a}").eqNullSafe(part(f"got_{a}")) for a in AXES if f"want_{a}" in cases.columns}
    out = cases.select("id", *(c.alias(f"{a}_ok") for a, c in ok.items()))
    whole = F.lit(True)
    for a in ok:
        whole = whole & F.col(f"{a}_ok")
    return out.withColumn("ok", whole)


RUNS = "run long, id string, category string, ok boolean"


def between_runs(runs: DataFrame, before: int, after: int) -> DataFrame:
    """id and what became of it from one run to the other: broken, mended, new or gone. What stays as it is has no row."""
    old, new = (runs.where(F.col("run") == n).select("id", F.col("ok").alias(c)) for n, c in ((before, "was"), (after, "ok")))
    change = F.when(F.col("was").isNull(), "new").when(F.col("ok").isNull(), "gone").when(F.col("was") & ~F.col("ok"), "broken").when(~F.col("was") & F.col("ok"), "mended")
    return old.join(new, "id", "full").select("id", change.alias("change")).where("change is not null")


def history(runs: DataFrame) -> DataFrame:
    """Cases and share of right ones by run."""
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("ok").cast("double")).alias("accuracy"))
