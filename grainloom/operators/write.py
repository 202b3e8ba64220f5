"""Guarded changes of tables, and flows of steps that can be undone. Tables are snapshots; a change writes a new one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import Forbidden, Refused
from ..state import Snapshots

OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v)}


@dataclass(frozen=True)
class AllowedTable:
    key: str
    operations: tuple[str, ...] = ("update",)
    columns: dict[str, str] = field(default_factory=dict)  # writable column -> type
    required: tuple[str, ...] = ()
    enums: dict[str, tuple] = field(default_factory=dict)
    max_rows: int = 100


@dataclass(frozen=True)
class Change:
    table: str
    operation: str
    values: dict[str, object] = field(default_factory=dict)
    where: tuple[tuple[str, str, object], ...] = ()


@dataclass
class Proposal:
    id: str
    change: Change
    proposer: str
    status: str = "pending"
    after: dict[str, str] = field(default_factory=dict)
    rows: int = 0
    before: dict[str, str] = field(default_factory=dict)


def checked(change: Change, allowed: dict[str, AllowedTable]) -> AllowedTable:
    t = allowed.get(change.table)
    if t is None or change.operation not in t.operations:
        raise Refused(f"{change.operation} of {change.table} isn't allowed")
    if change.operation in ("update", "delete") and not change.where:
        raise Refused(f"{change.operation} needs a condition")
    for c, v in change.values.items():
        if c not in t.columns:
            raise Refused(f"{change.table}.{c} may not be written")
        if c in t.enums and v not in t.enums[c]:
            raise Refused(f"{change.table}.{c}: {v!r} isn't one of {t.enums[c]}")
        if t.columns[c] in ("int", "bigint", "double") and (isinstance(v, bool) or not isinstance(v, (int, float))):
            raise Refused(f"{change.table}.{c}: {v!r} isn't a number")
    if change.operation == "insert" and (missing := [c for c in (t.key, *t.required) if change.values.get(c) in (None, "")]):
        raise Refused(f"insert into {change.table} needs {missing}")
    if change.operation == "update" and not change.values:
        raise Refused("update without values")
    for c, op, _ in change.where:
        if op not in OPS or not c.isidentifier():
            raise Refused(f"condition {c} {op} isn't allowed")
    return t


def condition(change: Change) -> Column:
    return reduce(and_, (OPS[op](F.col(c), v) for c, op, v in change.where))


def hit(df: DataFrame, change: Change) -> DataFrame:
    return df.where(F.coalesce(condition(change), F.lit(False)))


def changed(df: DataFrame, change: Change) -> DataFrame:
    if change.operation == "insert":
        row = df.sparkSession.range(1).select(*(F.lit(change.values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields))
        return df.unionByName(row)
    own = F.coalesce(condition(change), F.lit(False))
    if change.operation == "delete":
        return df.where(~own)
    return df.withColumns({c: F.when(own, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in change.values.items()})


@dataclass
class WriteBack:
    store: Snapshots
    allowed: dict[str, AllowedTable]
    approvers: tuple[str, ...]
    proposals: dict[str, Proposal] = field(default_factory=dict)

    def propose(self, change: Change, proposer: str) -> Proposal:
        t = checked(change, self.allowed)
        df = self.store.table(change.table)
        if change.operation == "insert":
            n = 1
            if hit(df, Change(change.table, "update", where=((t.key, "=", change.values[t.key]),))).head(1):
                raise Refused(f"{change.table} has {change.values[t.key]!r} already")
        else:
            n = hit(df, change).limit(t.max_rows + 1).count()
        if n > t.max_rows:
            raise Refused(f"more than {t.max_rows} rows would change")
        p = Proposal(f"p{len(self.proposals) + 1}", change, proposer, rows=n)
        self.proposals[p.id] = p
        return p

    def pending(self, id: str, user: str, role: str) -> Proposal:
        p = self.proposals[id]
        if p.status != "pending":
            raise Refused(f"{id} is {p.status}")
        if role not in self.approvers:
            raise Forbidden(f"role {role!r} may not decide")
        return p

    def approve(self, id: str, user: str, role: str) -> None:
        p = self.pending(id, user, role)
        if user == p.proposer:
            raise Forbidden("a proposal is decided by someone else")
        table, t = p.change.table, self.allowed[p.change.table]
        df = self.store.table(table)
        if p.change.operation != "insert" and hit(df, p.change).limit(t.max_rows + 1).count() > t.max_rows:
            raise Refused(f"more than {t.max_rows} rows would change by now")
        p.before = {table: self.store.current()[table]}
        p.after = self.store.write({table: changed(df, p.change)})
        self.store.point(p.after)
        p.status = "committed"

    def reject(self, id: str, user: str, role: str) -> None:
        p = self.proposals[id]
        if user != p.proposer:
            p = self.pending(id, user, role)
        elif p.status != "pending":
            raise Refused(f"{id} is {p.status}")
        p.status = "rejected"

    def rollback(self, id: str) -> None:
        """Back to the snapshot before. If the table has changed since, only this proposal's rows go back; refused if they have changed too."""
        p = self.proposals[id]
        if p.status != "committed":
            raise Refused(f"{id} is {p.status}")
        table = p.change.table
        if self.store.current()[table] == p.after[table]:
            self.store.point(p.before)
        else:
            self.store.commit({table: self.undone(p)})
        p.status = "rolled back"

    def undone(self, p: Proposal) -> DataFrame:
        """The table of now with the rows that the proposal changed as they were before, by key."""
        table, key = p.change.table, self.allowed[p.change.table].key
        before, after, now = self.store.version(p.before[table]), self.store.version(p.after[table]), self.store.table(table)
        came, gone = after.exceptAll(before), before.exceptAll(after)
        deleted = gone.join(came.select(key), key, "left_anti").select(key)
        if came.exceptAll(now).head(1) or now.join(deleted, key, "left_semi").head(1):
            raise Refused(f"rows that {p.id} changed have been changed since")
        return now.join(came.select(key), key, "left_anti").select(*now.columns).unionByName(gone)


@dataclass(frozen=True)
class Step:
    name: str
    do: Callable[[dict], dict] | None = None
    undo: Callable[[dict], None] | None = None
    human: bool = False


@dataclass
class Flow:
    """Steps in order; a human step pauses; a failure undoes what was done, last first."""

    steps: list[Step]
    state: dict = field(default_factory=dict)
    cursor: int = 0
    status: str = "running"
    errors: list[str] = field(default_factory=list)

    def run(self) -> str:
        while self.cursor < len(self.steps):
            step = self.steps[self.cursor]
            if step.human:
                self.status = "waiting"
                return self.status
            try:
                self.state |= step.do(self.state) or {} if step.do else {}
            except Exception as e:
                self.errors.append(f"{step.name}: {e}")
                self.undo("failed")
                return self.status
            self.cursor += 1
        self.status = "done"
        return self.status

    def undo(self, status: str) -> None:
        for step in reversed(self.steps[: self.cursor]):
            if step.undo:
                try:
                    step.undo(self.state)
                except Exception as e:
                    self.errors.append(f"undo {step.name}: {e}")
        self.status = status

    def approve(self) -> str:
        if self.status != "waiting":
            raise Refused(f"the flow is {self.status}")
        self.cursor += 1
        self.status = "running"
        return self.run()

    def reject(self) -> None:
        if self.status != "waiting":
            raise Refused(f"the flow is {self.status}")
        self.undo("rejected")

    def rollback(self) -> None:
        if self.status != "done":
            raise Refused(f"the flow is {self.status}")
        self.undo("rolled back")


def updated_from(df: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: new values where new has the key."""
    own = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    return df.join(own, F.col(key) == F.col("_key"), "left").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))
