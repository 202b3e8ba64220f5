"""Answers kept for a while as Parquet in the shared folder, so that they outlive executors."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .governance import Principal
from .plans.query import SemanticQuery
from .state import shared_dir


@dataclass(frozen=True)
class Kept:
    path: str
    at: datetime
    schema: StructType


@dataclass(frozen=True)
class Cached:
    """rows and how they were come by: `new`, `kept`, or `stale` if the making failed and an older answer stands in."""

    rows: DataFrame
    label: str
    at: datetime
    error: str = ""


def scope(q: SemanticQuery, who: Principal, version: str = "") -> str:
    """Who may see the same: role, attributes and tenant count, the user's name only as tenant; the model's version does too."""
    parts = (q.key(who.role), who.role, who.tenant, repr(sorted(who.attrs.items())), version)
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@dataclass
class Results:
    """An answer is made again after `ttl`; an older one, up to `stale` old, is given with its label if that fails. At most `most` answers are known."""

    spark: SparkSession
    ttl: timedelta
    stale: timedelta
    now: Callable[[], datetime]
    most: int = 1000
    known: dict[str, Kept] = field(default_factory=dict)

    def get(self, key: str, make: Callable[[], DataFrame]) -> Cached:
        kept, now = self.known.get(key), self.now()
        if kept and now - kept.at < self.ttl:
            return Cached(self.read(kept), "kept", kept.at)
        try:
            rows = make()
            new = Kept(f"{shared_dir(self.spark)}/answers/{uuid.uuid4().hex}", now, rows.schema)
            rows.write.parquet(new.path)
        except Exception as e:
            if kept and now - kept.at < self.stale:
                return Cached(self.read(kept), "stale", kept.at, f"{type(e).__name__}: {e}"[:500])
            raise
        self.known.pop(key, None)
        self.known[key] = new
        while len(self.known) > self.most:
            self.known.pop(next(iter(self.known)))
        return Cached(self.read(new), "new", now)

    def read(self, kept: Kept) -> DataFrame:
        return self.spark.read.schema(kept.schema).parquet(kept.path)

    def forget(self) -> None:
        """After a landing or a new model: nothing kept is given again."""
        self.known.clear()
