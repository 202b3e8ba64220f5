"""Which entities a row reaches without being counted twice."""

from __future__ import annotations

from ..errors import Ambiguous, Unreachable
from ..model import Join, Model


def steps(model: Model, entity: str) -> list[Join]:
    """Many-to-one edges from an entity; a one-to-many edge is walked backwards."""
    out = [j for j in model.joins if j.from_ == entity and j.cardinality == "many_to_one"]
    out += [Join(j.to, j.from_, j.to_key, j.from_key) for j in model.joins if j.to == entity and j.cardinality == "one_to_many"]
    return out


def path(model: Model, start: str, end: str) -> list[Join]:
    """The one shortest way from start to end; refused if there is none, or more than one."""
    level: list[list[Join]] = [[]]
    seen = {start}
    while level:
        found = [p for p in level if (p[-1].to if p else start) == end]
        if len(found) == 1:
            return found[0]
        if found:
            raise Ambiguous(f"{start} reaches {end} by {len(found)} ways of the same length; declare a role for each")
        level = [[*p, j] for p in level for j in steps(model, p[-1].to if p else start) if j.to not in seen]
        seen |= {p[-1].to for p in level}
    raise Unreachable(f"{end} can't be reached from {start} without counting rows twice")


def reachable(model: Model, start: str) -> set[str]:
    out, todo = {start}, [start]
    while todo:
        for j in steps(model, todo.pop()):
            if j.to not in out:
                out.add(j.to)
                todo.append(j.to)
    return out


def dimensions_for(model: Model, metric: str) -> set[str]:
    """Dimensions that a metric can be sliced by: those of all its bases."""
    sets = [reachable(model, model.metrics[b].entity) for b in model.bases(model.metric(metric).name)]
    entities = set.intersection(*sets)
    return {d.name for d in model.dimensions.values() if d.entity in entities}
