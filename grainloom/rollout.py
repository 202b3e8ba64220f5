"""Versions of a model: one active, one canary at most; callers are routed by a stable bucket."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import Refused
from .functions import bucket as bucket_of
from .model import Model


def bucket(key: str) -> int:
    h = 2166136261
    for b in key.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % 100


def version_id(model: Model) -> str:
    return hashlib.sha256(json.dumps(model.as_doc(), sort_keys=True).encode()).hexdigest()[:12]


@dataclass
class Rollout:
    versions: dict[str, str] = field(default_factory=dict)  # id -> candidate, canary, active or retired
    percent: int = 0

    def add(self, id: str) -> None:
        self.versions.setdefault(id, "candidate")

    def of(self, status: str) -> str | None:
        return next((v for v, s in self.versions.items() if s == status), None)

    def canary(self, id: str, percent: int) -> None:
        if self.versions.get(id) != "candidate" or self.of("canary") or not 0 < percent <= 100:
            raise Refused("a canary is a candidate, one at a time, for 1 to 100 per cent")
        self.versions[id], self.percent = "canary", percent

    def activate(self, id: str) -> None:
        if id not in self.versions:
            raise Refused(f"unknown version {id}")
        if active := self.of("active"):
            self.versions[active] = "retired"
        self.versions[id], self.percent = "active", 0

    def rollback(self) -> None:
        if c := self.of("canary"):
            self.versions[c], self.percent = "retired", 0

    def route(self, key: str) -> str | None:
        c = self.of("canary")
        return c if c and bucket(key) < self.percent else self.of("active")

    def watch(self, passed: int, total: int, floor: float) -> bool:
        """Rolls the canary back if fewer of its checks pass than the floor; whether it stays."""
        if total and passed / total < floor:
            self.rollback()
            return False
        return True


def simulated(spark: SparkSession, n: int, percent: int) -> DataFrame:
    """version and keys: how n keys would be routed."""
    b = bucket_of(F.concat(F.lit("user-"), F.col("id").cast("string")))
    return spark.range(n).groupBy(F.when(b < percent, "canary").otherwise("active").alias("version")).agg(F.count(F.lit(1)).alias("keys"))


def changed_metrics(a: Model, b: Model) -> dict[str, list[str]]:
    """Metrics added, removed and changed from a to b."""
    x, y = ({n: asdict(m) for n, m in m.metrics.items()} for m in (a, b))
    return {"added": sorted(set(y) - set(x)), "removed": sorted(set(x) - set(y)), "changed": sorted(n for n in set(x) & set(y) if x[n] != y[n])}
