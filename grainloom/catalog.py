"""Tables of a database, with the predicates of a session below everything that is planned on them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from .errors import Refused
from .model import Model


@dataclass
class Catalog:
    """Parquet tables in a folder, or frames given by name."""

    spark: SparkSession
    root: str | None = None
    frames: Mapping[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        if self.root is None or not name.replace("_", "").isalnum():
            raise Refused(f"unknown table {name!r}")
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def explore(self, name: str, n: int = 50) -> DataFrame:
        return self.table(name).limit(n)

    def resolver(self, model: Model, rules: Mapping[str, Column] | None = None):
        """entity -> rows; rules: a predicate by entity, applied wherever the entity is read."""

        def resolve(entity: str) -> DataFrame:
            df = self.table(model.entities[entity].table)
            return df.where(rules[entity]) if rules and entity in rules else df

        return resolve


@dataclass
class Registry:
    """Databases by name; the first is the default."""

    databases: dict[str, tuple[Catalog, Model | None]] = field(default_factory=dict)
    raw_allowed: set[str] = field(default_factory=set)

    def get(self, name: str | None = None) -> tuple[Catalog, Model | None]:
        name = name or next(iter(self.databases), None)
        if name not in self.databases:
            raise Refused(f"unknown database {name!r}; known: {sorted(self.databases)}")
        return self.databases[name]

    def raw(self, name: str | None = None) -> Catalog:
        """For raw statements: a modelled database refuses them unless it opted in."""
        catalog, model = self.get(name)
        if model is not None and (name or next(iter(self.databases))) not in self.raw_allowed:
            raise Refused("this database has a model; ask for metrics")
        return catalog
