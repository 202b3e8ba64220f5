"""A batch of tables beside production: compared before it is promoted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ..state import Snapshots


def pct(main, branch):
    """Change in per cent, two decimals; from 0 it is 100, or 0 if nothing changed."""
    change = F.round((branch - main) / F.nullif(main, F.lit(0)) * 100, 2)
    return F.when(main == 0, F.when(branch == 0, 0.0).otherwise(100.0)).otherwise(change)


def totals(df: DataFrame, keys: tuple[str, ...]) -> dict[str, float]:
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numbers)).first()
    return {k: float(v) for k, v in row.asDict().items()}


def diff(main: DataFrame, branch: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """measure, main, branch, pct: the number of rows and the sum of each number that isn't a key. One pass a side."""
    numbers = [f.name for f in main.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys and f.name in branch.columns]
    aggs = [F.count(F.lit(1)).cast("double").alias("_rows"), *(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in numbers)]
    long = lambda df, name: df.agg(*aggs).select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias(name)) for c in ("_rows", *numbers)))))
    both = long(main, "main").join(long(branch, "branch"), "measure")
    return both.withColumn("pct", pct(F.col("main"), F.col("branch")))


def flags(rows_main: float, rows_branch: float, sums: dict[str, float]) -> list[str]:
    """What is suspicious; sums: change in per cent by column."""
    out = [f"{c} total changed {p:+.1f}%" for c, p in sums.items() if abs(p) >= 30]
    if rows_main > 0 and rows_branch == 2 * rows_main:
        out.append("exactly twice the rows: loaded twice")
    if rows_branch < rows_main:
        out.append(f"{int(rows_main - rows_branch)} rows fewer than production")
    moved = (0.0 if not rows_branch else 100.0) if not rows_main else (rows_branch - rows_main) / rows_main * 100
    if abs(moved) < 1:
        out += [f"as many rows but {c} rose {p:+.1f}%: another unit or definition" for c, p in sums.items() if p >= 50]
    return sorted(out)


@dataclass
class Branches:
    """Branches of a snapshot store; promotion makes all tables of a branch current at once."""

    store: Snapshots

    def create(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        return self.store.write(tables)

    def compare(self, versions: dict[str, str], keys: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
        out = {}
        for name, version in versions.items():
            rows = {r["measure"]: r for r in diff(self.store.table(name), self.store.spark.read.parquet(f"{self.store.root}/{version}"), keys.get(name, ())).collect()}
            n = rows.pop("_rows")
            out[name] = flags(n["main"], n["branch"], {c: r["pct"] for c, r in rows.items()})
        return out

    def promote(self, versions: dict[str, str]) -> dict[str, str]:
        return self.store.point(versions)
