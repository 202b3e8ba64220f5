"""Landing: mapping, required fields, keys, the validation gate, staging and insert-if-absent."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..errors import Refused
from ..sources.infer import fold


@dataclass(frozen=True)
class Mapping:
    """target -> source column."""

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)


def mapping(columns: list[str], targets: list[str] | None = None, **how) -> Mapping:
    """Every column under its folded name; or, for each target, the column equal to it once folded, else the first that holds it or is held."""
    if targets is None:
        return Mapping({fold(c): c for c in columns}, **how)
    out, free = {}, list(columns)
    for t in targets:
        exact = [c for c in free if fold(c) == fold(t)]
        near = [c for c in free if fold(c) and (fold(c) in fold(t) or fold(t) in fold(c))]
        if exact or near:
            out[t] = (exact or near)[0]
            free.remove(out[t])
    return Mapping(out, **how)


def unmapped(columns: list[str], m: Mapping) -> list[str]:
    return [c for c in columns if c not in m.columns.values()]


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def mapped(df: DataFrame, m: Mapping) -> DataFrame:
    """Target columns, the constant tags, and in _missing the required fields that are blank."""
    out = df.select(*(F.col(f"`{s}`").alias(t) for t, s in m.columns.items()), *(F.lit(v).alias(k) for k, v in m.tags.items()))
    absent = [r for r in m.required if r not in m.columns]
    missing = [F.when(blank(F.col(f"`{r}`")), F.lit(r)) for r in m.required if r in m.columns] + [F.lit(r) for r in absent]
    return out.withColumn("_missing", F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("_missing") == 0).drop("_missing")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.size("_missing") > 0).withColumn("_reason", F.concat(F.lit("missing "), F.array_join("_missing", ", "))).drop("_missing")


def key_faults(df: DataFrame, key: list[str]) -> DataFrame:
    """null_keys and repeated_keys of a declared key: both 0 if it identifies rows."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    empty = F.lit(False)
    for k in key:
        empty = empty | F.col(k).isNull()
    return per.agg(F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("null_keys"), F.count(F.when(~empty & (F.col("n") > 1), 1)).alias("repeated_keys"))


def check_key(df: DataFrame, key: list[str]) -> None:
    r = key_faults(df, key).first()
    if r["null_keys"] or r["repeated_keys"]:
        raise Refused(f"key {key} doesn't identify rows: {r['null_keys']} null, {r['repeated_keys']} repeat")


def first_per_key(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """One row for each key, the first in the order of all columns if no other is given."""
    by = order or [c for c in df.columns if c not in key]
    w = W.partitionBy(*key).orderBy(*by) if by else W.partitionBy(*key).orderBy(*key)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def gate(staged: DataFrame, key: str, casts: dict[str, str], required_refs: dict[str, tuple[DataFrame, str]] | None = None, optional_refs: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows of text that are fit to be inserted.

    The key is a number and comes once; required references exist, optional ones that don't become null; values are
    cast, and what can't be cast is null.
    """
    df = first_per_key(staged.where(F.col(key).rlike("^[0-9]+$")), [key])
    for c, (parent, parent_key) in (required_refs or {}).items():
        df = df.join(parent.select(F.col(parent_key).cast("string").alias(c)), c, "left_semi")
    for c, (parent, parent_key) in (optional_refs or {}).items():
        known = parent.select(F.col(parent_key).cast("string").alias("_ref")).distinct()
        df = df.join(known, F.col(c) == F.col("_ref"), "left").withColumn(c, F.col("_ref")).drop("_ref")
    return df.select(*(F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in staged.columns))


def absent(new: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key the target doesn't have."""
    return new.join(target.select(*key), key, "left_anti").select(*new.columns)


def upserted(new: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """The target with the rows it doesn't have: doing it twice changes nothing."""
    return target.unionByName(absent(first_per_key(new, key), target, key).select(*target.columns))
