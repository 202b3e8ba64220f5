"""What a caller asks for."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, functions as F

from ..errors import Refused
from ..model import Model

OPERATORS = {
    "=": lambda c, v: c == v[0],
    "!=": lambda c, v: c != v[0],
    ">": lambda c, v: c > v[0],
    ">=": lambda c, v: c >= v[0],
    "<": lambda c, v: c < v[0],
    "<=": lambda c, v: c <= v[0],
    "in": lambda c, v: c.isin(*v),
}
GRAINS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Filter:
    dimension: str
    op: str
    values: tuple

    def on(self, column: Column, kind: str) -> Column:
        """The predicate; values take the type of the column, and a value that can't is an error."""
        if self.op not in OPERATORS or not self.values:
            raise Refused(f"filter on {self.dimension}: {self.op!r} with {len(self.values)} values isn't one of {list(OPERATORS)}")
        return OPERATORS[self.op](column, [F.lit(v).cast(kind) for v in self.values])


@dataclass(frozen=True)
class SemanticQuery:
    metrics: tuple[str, ...]
    group_by: tuple[str, ...] = ()
    where: tuple[Filter, ...] = ()
    time_grain: str | None = None
    order_by: tuple[tuple[str, bool], ...] = ()  # name, descending
    limit: int | None = None

    def canonical(self, model: Model) -> SemanticQuery:
        """Synonyms resolved, repeats dropped."""
        if not self.metrics:
            raise Refused("no metric")
        if self.time_grain and self.time_grain not in GRAINS:
            raise Refused(f"time grain {self.time_grain!r} isn't one of {GRAINS}")
        return replace(
            self,
            metrics=tuple(dict.fromkeys(model.metric(m).name for m in self.metrics)),
            group_by=tuple(dict.fromkeys(model.dimension(d).name for d in self.group_by)),
            where=tuple(replace(f, dimension=model.dimension(f.dimension).name, values=tuple(f.values)) for f in self.where),
        )

    def key(self, scope: str = "") -> str:
        """The same for the same query and scope of the caller."""
        return hashlib.sha256((json.dumps(asdict(self), sort_keys=True, default=str) + "\0" + scope).encode()).hexdigest()
