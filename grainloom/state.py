"""Small state as Parquet: tables that are appended to, and snapshots behind a pointer.

One writer at a time is assumed. A snapshot is written to a new folder first; the pointer, one small file, is then
replaced, so that readers see the old tables or the new ones.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import Refused


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. One of our own only where all runs on this machine."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and not spark.sparkContext.master.startswith("local"):
        raise Refused("set spark.checkpoint.dir to a folder that all executors share")
    return (own or "/tmp/checkpoints").rstrip("/")


@dataclass
class StateTable:
    spark: SparkSession
    path: str
    schema: str

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        df.coalesce(1).write.mode("append").parquet(self.path)


@dataclass
class Snapshots:
    """Named tables of which the current version is what the pointer says."""

    spark: SparkSession
    root: str

    @property
    def pointer(self) -> str:
        return os.path.join(self.root, "_current.json")

    def current(self) -> dict[str, str]:
        if not os.path.exists(self.pointer):
            return {}
        with open(self.pointer, encoding="utf-8") as f:
            return json.load(f)

    def version(self, id: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, id))

    def table(self, name: str) -> DataFrame:
        return self.version(self.current()[name])

    def write(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Writes versions that nothing points to yet."""
        out = {}
        for name, df in tables.items():
            out[name] = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(os.path.join(self.root, out[name]))
        return out

    def point(self, versions: dict[str, str]) -> dict[str, str]:
        """Makes all versions current at once; returns what was current before."""
        before = self.current()
        os.makedirs(self.root, exist_ok=True)
        temporary = f"{self.pointer}.{uuid.uuid4().hex}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({**before, **versions}, f)
        os.replace(temporary, self.pointer)
        return before

    def commit(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        return self.point(self.write(tables))
