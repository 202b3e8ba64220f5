"""Who may ask what, and what of the answer they see.

The order matters: names, roles, budget, row filters, the hidden cohort count, the plan, suppression, masks, limit;
then the audit and the charge. Everything up to the limit is part of one lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import Forbidden, Refused
from .guard import MAX_ROWS, raw_sql
from .model import Model
from .plans.planner import Resolver, plan
from .plans.query import Filter, SemanticQuery
from .state import StateTable

AUDIT = "at timestamp, user string, role string, metrics array<string>, group_by array<string>, refused boolean, note string, question string, engagement string, plan string"
SPEND = "at timestamp, tenant string, amount double"
#: Column of the cohort count while an answer is made.
COHORT = "_cohort"


@dataclass(frozen=True)
class Principal:
    user: str
    role: str
    attrs: dict[str, str] = field(default_factory=dict)
    question: str = ""
    engagement: str = ""

    @property
    def tenant(self) -> str:
        return self.attrs.get("tenant") or self.user


@dataclass(frozen=True)
class RowRule:
    """Callers of these roles see only rows whose dimension equals their attribute."""

    roles: tuple[str, ...]
    dimension: str
    attribute: str


@dataclass(frozen=True)
class Policy:
    row_rules: tuple[RowRule, ...] = ()
    unmasked_roles: tuple[str, ...] = ("admin",)
    k: int = 0
    count_metric: str | None = None
    protected: tuple[str, ...] = ()
    exempt_roles: tuple[str, ...] = ("admin",)
    budgets: dict[str, float] = field(default_factory=dict)
    #: Roles of the operands of a formula count too.
    transitive_roles: bool = True


def check_roles(model: Model, q: SemanticQuery, who: Principal, transitive: bool) -> None:
    def names(n: str) -> list[str]:
        return [n, *(x for o in model.metrics[n].operands for x in names(o))] if transitive else [n]

    for m in q.metrics:
        for n in names(m):
            roles = model.metrics[n].roles
            if roles and who.role not in roles:
                raise Forbidden(f"role {who.role!r} may not see {n}")


def scoped(q: SemanticQuery, policy: Policy, who: Principal) -> SemanticQuery:
    """The query with the caller's row filters; a caller without the attribute is refused."""
    extra = []
    for rule in policy.row_rules:
        if who.role in rule.roles:
            value = who.attrs.get(rule.attribute)
            if not value:
                raise Forbidden(f"role {who.role!r} needs the attribute {rule.attribute!r}")
            extra.append(Filter(rule.dimension, "=", (value,)))
    return replace(q, where=(*q.where, *extra))


def guarded(q: SemanticQuery, policy: Policy, who: Principal) -> bool:
    return policy.k > 0 and bool(policy.count_metric) and who.role not in policy.exempt_roles and any(d in policy.protected for d in q.group_by)


def suppressed(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col(COHORT) >= k).drop(COHORT)


def masked(df: DataFrame, model: Model, q: SemanticQuery, policy: Policy, who: Principal) -> DataFrame:
    """A literal instead of values, after aggregation: groups stay rows of their own."""
    if who.role in policy.unmasked_roles:
        return df
    masks = {d: F.lit(model.dimensions[d].mask) for d in q.group_by if model.dimensions[d].mask is not None}
    return df.withColumns(masks) if masks else df


def answer(model: Model, query: SemanticQuery, policy: Policy, who: Principal, resolve: Resolver) -> DataFrame:
    """The part of an answer that is a plan."""
    q = query.canonical(model)
    check_roles(model, q, who, policy.transitive_roles)
    q = scoped(q, policy, who).canonical(model)
    if not guarded(q, policy, who):
        return masked(plan(model, q, resolve), model, q, policy, who)
    cohort = replace(model.metrics[policy.count_metric], name=COHORT)
    own = Model(model.entities, model.joins, model.dimensions, {**model.metrics, COHORT: cohort})
    df = suppressed(plan(own, replace(q, metrics=(*q.metrics, COHORT), order_by=(), limit=None), resolve), policy.k)
    if q.order_by:
        df = df.orderBy(*(F.col(n).desc_nulls_last() if desc else F.col(n).asc_nulls_last() for n, desc in q.order_by))
    df = masked(df, model, q, policy, who)
    return df if q.limit is None else df.limit(q.limit)


def spend_by_tenant(spend: DataFrame) -> DataFrame:
    return spend.groupBy("tenant").agg(F.sum("amount").alias("spent"))


@dataclass
class Governed:
    """Answers with a budget, an audit and a charge; `now` is given by the caller."""

    model: Model
    policy: Policy
    resolve: Resolver
    audit: StateTable
    spend: StateTable
    now: Callable[[], datetime]

    def spent(self, tenant: str) -> float:
        return self.spend.read().where(F.col("tenant") == tenant).agg(F.coalesce(F.sum("amount"), F.lit(0.0))).first()[0]

    def reset(self, tenant: str) -> None:
        self.spend.append([(self.now(), tenant, -self.spent(tenant))])

    def by_tenant(self) -> DataFrame:
        return spend_by_tenant(self.spend.read())

    def ask(self, query: SemanticQuery, who: Principal, cost: float = 1.0) -> DataFrame:
        def record(refused: bool, note: str, q: SemanticQuery) -> None:
            self.audit.append([(self.now(), who.user, who.role, list(q.metrics), list(q.group_by), refused, note, who.question, who.engagement, q.key(who.role))])

        try:
            limit = self.policy.budgets.get(who.tenant)
            if limit is not None and self.spent(who.tenant) >= limit:
                raise Forbidden(f"the budget of {who.tenant!r} is spent")
            df = answer(self.model, query, self.policy, who, self.resolve)
        except Exception as e:  # a planning error is recorded too
            record(True, str(e) if isinstance(e, Refused) else f"{type(e).__name__}: {e}"[:500], query)
            raise
        record(False, "", query)
        self.spend.append([(self.now(), who.tenant, cost)])
        return df


    def raw(self, spark: SparkSession, sql: str, who: Principal, cap: int = MAX_ROWS) -> DataFrame:
        """A read-only statement; it is recorded whether it is refused or not."""

        def record(refused: bool, note: str) -> None:
            self.audit.append([(self.now(), who.user, who.role, [], [], refused, note, sql, who.engagement, "raw")])

        try:
            df = raw_sql(spark, sql, cap)
        except Exception as e:
            record(True, str(e) if isinstance(e, Refused) else f"{type(e).__name__}: {e}"[:500])
            raise
        record(False, "")
        return df


@dataclass(frozen=True)
class Threat:
    id: str
    title: str
    vector: str
    control: str
    owner: str
    status: str
    evidence: str = ""


def threat_issues(threats: list[Threat]) -> list[str]:
    """Missing fields, repeated ids, and threats that are neither mitigated nor accepted."""
    out, seen = [], set()
    for t in threats:
        out += [f"{t.id or '?'}: no {n}" for n in ("id", "title", "vector", "control", "owner") if not getattr(t, n)]
        if t.id in seen:
            out.append(f"{t.id}: id is used twice")
        seen.add(t.id)
        if t.status not in ("mitigated", "accepted", "transferred"):
            out.append(f"{t.id}: status {t.status!r} isn't addressed")
    return out
