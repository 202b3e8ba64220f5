"""The declared model: entities, join edges, dimensions and metrics, with validation and lint."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

import yaml

from .errors import InvalidModel, UnknownName

AGGREGATES = ("sum", "count", "count_distinct", "avg", "last_value")
CARDINALITIES = ("many_to_one", "one_to_many", "many_to_many")
NAME = re.compile(r"[A-Za-z_]\w*")
WINDOW = re.compile(r"(rolling|delta|prior|cumulative)(?::(\d+))?$")
RESETS = ("month", "quarter", "year")
#: Words of formulas that aren't metrics.
FUNCTIONS = frozenset("nullif coalesce abs round floor ceil greatest least case when then else end and or not null is cast as double int bigint decimal true false if sqrt ln exp power".split())


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    primary_key: str | None = None


@dataclass(frozen=True)
class Join:
    from_: str
    to: str
    from_key: str
    to_key: str
    cardinality: str = "many_to_one"


@dataclass(frozen=True)
class Dimension:
    name: str
    entity: str
    column: str
    type: str = "categorical"
    synonyms: tuple[str, ...] = ()
    mask: str | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    description: str = ""
    synonyms: tuple[str, ...] = ()
    entity: str | None = None
    agg: str | None = None
    expr: str | None = None
    formula: str | None = None
    of: str | None = None
    window: str | None = None
    reset: str | None = None
    additivity: str | None = None
    roles: tuple[str, ...] = ()
    time: str | None = None
    fill_zero: bool = False

    @property
    def kind(self) -> str:
        return "window" if self.window else "derived" if self.formula else "simple"

    @property
    def operands(self) -> tuple[str, ...]:
        """Names in the formula, or the metric a window runs over."""
        if self.window:
            return (self.of,) if self.of else ()
        return tuple(dict.fromkeys(w for w in NAME.findall(self.formula or "") if w.lower() not in FUNCTIONS))

    def span(self) -> tuple[str, int]:
        m = WINDOW.match(self.window or "")
        if not m:
            raise InvalidModel(f"metric {self.name}: window {self.window!r} isn't rolling:N, delta[:N], prior[:N] or cumulative")
        return m[1], int(m[2] or 1)


@dataclass(frozen=True)
class Issue:
    severity: str
    target: str
    message: str


@dataclass
class Model:
    entities: dict[str, Entity] = field(default_factory=dict)
    joins: list[Join] = field(default_factory=list)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    @classmethod
    def of(cls, doc: dict[str, Any]) -> Model:
        def made(kind, row: dict):
            names = {f.name for f in fields(kind)}
            own = {("from_" if k == "from" and kind is Join else k): tuple(v) if isinstance(v, list) else v for k, v in row.items()}
            if extra := set(own) - names:
                raise InvalidModel(f"unknown keys {sorted(extra)} in {row.get('name', row)}")
            return kind(**own)

        def by_name(kind, key: str) -> dict:
            out = {}
            for row in doc.get(key) or []:
                x = made(kind, row)
                if x.name in out:
                    raise InvalidModel(f"{key}: {x.name} is declared twice")
                out[x.name] = x
            return out

        if extra := set(doc) - {"entities", "joins", "dimensions", "metrics"}:
            raise InvalidModel(f"unknown keys {sorted(extra)}")
        m = cls(by_name(Entity, "entities"), [made(Join, r) for r in doc.get("joins") or []], by_name(Dimension, "dimensions"), by_name(Metric, "metrics"))
        m.validate()
        return m

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {})

    def validate(self) -> None:
        """Every reference resolves."""
        for j in self.joins:
            if j.from_ not in self.entities or j.to not in self.entities:
                raise InvalidModel(f"join {j.from_} -> {j.to}: unknown entity")
            if j.cardinality not in CARDINALITIES:
                raise InvalidModel(f"join {j.from_} -> {j.to}: unknown cardinality {j.cardinality}")
        for d in self.dimensions.values():
            if d.entity not in self.entities:
                raise InvalidModel(f"dimension {d.name}: unknown entity {d.entity}")
            if d.type not in ("categorical", "time"):
                raise InvalidModel(f"dimension {d.name}: unknown type {d.type}")
        for m in self.metrics.values():
            if m.kind == "simple":
                if m.entity not in self.entities or m.agg not in AGGREGATES or not m.expr:
                    raise InvalidModel(f"metric {m.name}: needs a known entity, an aggregate of {AGGREGATES} and an expr")
            for name in m.operands:
                if name not in self.metrics:
                    raise InvalidModel(f"metric {m.name}: unknown metric {name}")
            if m.kind == "window":
                m.span()
                if not m.of or (m.reset and m.reset not in RESETS):
                    raise InvalidModel(f"metric {m.name}: needs `of`, and a reset of {RESETS} if any")
        for m in self.metrics.values():
            self.bases(m.name)

    def bases(self, name: str, above: tuple[str, ...] = ()) -> tuple[str, ...]:
        """The simple metrics that a metric is made of."""
        if name in above:
            raise InvalidModel(f"metric {name} is defined by itself")
        m = self.metrics[name]
        if m.kind == "simple":
            return (name,)
        return tuple(dict.fromkeys(b for o in m.operands for b in self.bases(o, (*above, name))))

    def additivity(self, name: str) -> str:
        m = self.metrics[name]
        if m.additivity:
            return m.additivity
        if m.kind == "simple":
            return {"sum": "additive", "count": "additive", "last_value": "semi_additive"}.get(m.agg, "non_additive")
        if m.kind == "derived" and not re.search(r"[*/]|\b(?:nullif|case|if)\b", m.formula.lower()):
            return "additive" if all(self.additivity(o) == "additive" for o in m.operands) else "non_additive"
        return "non_additive"

    def metric(self, name: str) -> Metric:
        """By name or synonym."""
        if name in self.metrics:
            return self.metrics[name]
        low = name.strip().lower()
        for m in self.metrics.values():
            if low == m.name.lower() or low in (s.lower() for s in m.synonyms):
                return m
        raise UnknownName(f"unknown metric {name!r}")

    def dimension(self, name: str) -> Dimension:
        if name in self.dimensions:
            return self.dimensions[name]
        low = name.strip().lower()
        for d in self.dimensions.values():
            if low == d.name.lower() or low in (s.lower() for s in d.synonyms):
                return d
        raise UnknownName(f"unknown dimension {name!r}")

    def lint(self) -> list[Issue]:
        """What a reviewer should look at."""
        out = []
        seen: dict[str, str] = {}
        for m in self.metrics.values():
            if not m.description:
                out.append(Issue("error", m.name, "no description"))
            for s in (m.name, *m.synonyms):
                other = seen.setdefault(s.lower(), m.name)
                if other != m.name:
                    out.append(Issue("error", m.name, f"synonym {s!r} also names {other}"))
            if m.formula and re.search(r"/(?!\s*nullif\b)", m.formula.lower()):
                out.append(Issue("warning", m.name, "divides without nullif"))
        for d in self.dimensions.values():
            for s in d.synonyms:
                other = seen.setdefault(s.lower(), d.name)
                if other != d.name:
                    out.append(Issue("warning", d.name, f"synonym {s!r} also names {other}"))
        for j in self.joins:
            if j.cardinality == "many_to_many":
                out.append(Issue("warning", f"{j.from_}->{j.to}", "many-to-many edges are never walked; declare a bridge"))
        return out

    def merged(self, fragment: dict[str, Any]) -> Model:
        """The model with the parts of a fragment added or replaced by name."""
        doc = self.as_doc()
        for key in ("entities", "dimensions", "metrics"):
            own = {r["name"]: r for r in doc[key]}
            own |= {r["name"]: r for r in fragment.get(key) or []}
            doc[key] = list(own.values())
        doc["joins"] += [j for j in fragment.get("joins") or [] if j not in doc["joins"]]
        return Model.of(doc)

    def as_doc(self) -> dict[str, list[dict]]:
        def row(x) -> dict:
            return {f.name.rstrip("_"): list(v) if isinstance(v, tuple) else v for f in fields(x) if (v := getattr(x, f.name)) not in (None, "", (), False)}

        return {"entities": [row(x) for x in self.entities.values()], "joins": [row(x) for x in self.joins], "dimensions": [row(x) for x in self.dimensions.values()], "metrics": [row(x) for x in self.metrics.values()]}
