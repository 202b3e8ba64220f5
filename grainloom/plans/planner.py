"""A semantic query as a DataFrame.

Measures of one entity are aggregated together at their own grain, with the dimensions joined many-to-one first; the
results of several entities are put side by side by a union and one more aggregation over the keys, which treats
null keys as equal and never multiplies rows. Formulas and windows follow. Nothing is run here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..errors import NonAdditive, Refused
from ..model import NAME, Metric, Model
from .graph import path
from .query import SemanticQuery

Resolver = Callable[[str], DataFrame]


def joined(model: Model, entity: str, dimensions: set[str], resolve: Resolver) -> tuple[DataFrame, dict[str, str]]:
    """An entity's rows with the entities of the dimensions, and the column of each dimension."""
    df = resolve(entity)
    at = {entity: ""}
    columns: dict[str, str] = {}
    for name in sorted(dimensions):
        d = model.dimensions[name]
        for j in path(model, entity, d.entity):
            if j.to in at:
                continue
            prefix = f"{j.to}__"
            other = resolve(j.to)
            df = df.join(other.select(*(F.col(c).alias(prefix + c) for c in other.columns)), F.col(at[j.from_] + j.from_key) == F.col(prefix + j.to_key), "left")
            at[j.to] = prefix
        columns[name] = at[d.entity] + d.column
    return df, columns


def aggregate(m: Metric, model: Model) -> Column:
    e = F.expr(m.expr)
    if m.agg == "last_value":
        time = next((d.column for d in model.dimensions.values() if d.entity == m.entity and d.type == "time" and m.time in (None, d.name)), None)
        if time is None:
            raise Refused(f"metric {m.name}: last_value needs a time dimension on {m.entity}")
        return F.max_by(e, F.struct(F.col(time), e))  # of several at the latest time, the greatest
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg}[m.agg](e)


def base(model: Model, entity: str, metrics: list[str], q: SemanticQuery, resolve: Resolver) -> DataFrame:
    """The simple metrics of one entity by the query's dimensions."""
    used = {*q.group_by, *(f.dimension for f in q.where)}
    df, columns = joined(model, entity, used, resolve)
    kinds = dict(df.dtypes)
    for f in q.where:
        df = df.where(f.on(F.col(columns[f.dimension]), kinds[columns[f.dimension]]))
    keys = []
    for name in q.group_by:
        d, c = model.dimensions[name], F.col(columns[name])
        if d.type == "time" and q.time_grain:
            if not isinstance(df.schema[columns[name]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                raise Refused(f"dimension {name} is declared as time but isn't a date")
            c = F.to_date(F.date_trunc(q.time_grain, c))
        keys.append(c.alias(f"_k_{name}"))
    values = [aggregate(model.metrics[m], model).alias(m) for m in metrics]
    return df.groupBy(*keys).agg(*values) if keys else df.agg(*values)


def side_by_side(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Null-safe full outer join of aggregates, as one union and aggregation."""
    if len(parts) == 1:
        return parts[0]
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    values = [F.max(c).alias(c) for c in all_.columns if c not in keys]
    return all_.groupBy(*keys).agg(*values) if keys else all_.agg(*values)


def formula(m: Metric) -> Column:
    """Identifiers stand for metric columns; they are replaced as tokens, never as parts of other names."""
    return F.expr(NAME.sub(lambda x: f"`{x[0]}`" if x[0] in m.operands else x[0], m.formula))


def windowed(m: Metric, q: SemanticQuery, model: Model) -> Column:
    times = [d for d in q.group_by if model.dimensions[d].type == "time"]
    if not times:
        raise Refused(f"metric {m.name} needs a time dimension in group_by")
    kind, n = m.span()
    if kind in ("rolling", "cumulative") and model.additivity(m.of) != "additive":
        raise NonAdditive(f"metric {m.name} would sum {m.of} over periods, which is {model.additivity(m.of)}")
    t = F.col(f"_k_{times[0]}")
    rest = [F.col(f"_k_{d}") for d in q.group_by if d != times[0]]
    if m.reset:
        rest.append(F.date_trunc(m.reset, t))
    w = W.partitionBy(*rest).orderBy(t)
    c = F.col(m.of)
    if kind == "rolling":
        return F.sum(c).over(w.rowsBetween(-(n - 1), 0))
    if kind == "cumulative":
        return F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0))
    return F.lag(c, n).over(w) if kind == "prior" else c - F.lag(c, n).over(w)


def plan(model: Model, query: SemanticQuery, resolve: Resolver) -> DataFrame:
    """Columns: the dimensions in the order asked for, then the metrics."""
    q = query.canonical(model)
    by_entity: dict[str, list[str]] = {}
    for name in q.metrics:
        for b in model.bases(name):
            own = by_entity.setdefault(model.metrics[b].entity, [])
            if b not in own:
                own.append(b)
    keys = [f"_k_{d}" for d in q.group_by]
    df = side_by_side([base(model, e, ms, q, resolve) for e, ms in by_entity.items()], keys)
    done = {b for ms in by_entity.values() for b in ms}
    for b in sorted(done):
        if model.metrics[b].fill_zero:
            df = df.withColumn(b, F.coalesce(b, F.lit(0)))

    def add(name: str) -> None:
        nonlocal df
        m = model.metrics[name]
        if name in done:
            return
        for o in m.operands:
            add(o)
        df = df.withColumn(name, windowed(m, q, model) if m.kind == "window" else formula(m))
        done.add(name)

    for name in q.metrics:
        add(name)
    df = df.select(*(F.col(f"_k_{d}").alias(d) for d in q.group_by), *q.metrics)
    if q.order_by:
        df = df.orderBy(*(F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_last() for n, desc in q.order_by))
    return df if q.limit is None else df.limit(q.limit)


def explain(model: Model, query: SemanticQuery) -> str:
    """What would be done, without doing it; the same text for the same query."""
    q = query.canonical(model)
    lines = []
    for name in q.metrics:
        for b in model.bases(name):
            m = model.metrics[b]
            ways = [" -> ".join([m.entity, *(j.to for j in path(model, m.entity, model.dimensions[d].entity))]) for d in sorted({*q.group_by, *(f.dimension for f in q.where)})]
            lines.append(f"{b}: {m.agg}({m.expr}) at {m.entity}" + "".join(f"; {w}" for w in ways))
        if model.metrics[name].kind != "simple":
            lines.append(f"{name}: {model.metrics[name].formula or model.metrics[name].window + ' of ' + model.metrics[name].of}")
    return "\n".join(dict.fromkeys(lines))


def shadow_diff(query: SemanticQuery, a: Model, b: Model, resolve: Resolver) -> DataFrame:
    """Rows that two models don't agree on, by side."""
    x, y = plan(a, query, resolve), plan(b, query, resolve)
    return x.exceptAll(y).withColumn("side", F.lit("a")).union(y.exceptAll(x).withColumn("side", F.lit("b")))


def broken_keys(model: Model, resolve: Resolver) -> dict[str, int]:
    """Entities that are joined to although their key repeats, with the number of repeated keys."""
    out = {}
    for name in sorted({j.to for j in model.joins if j.cardinality == "many_to_one"} | {j.from_ for j in model.joins if j.cardinality == "one_to_many"}):
        key = next(j.to_key if j.to == name else j.from_key for j in model.joins if name in (j.to, j.from_))
        n = resolve(name).groupBy(key).count().where("count > 1").count()
        if n:
            out[name] = n
    return out
