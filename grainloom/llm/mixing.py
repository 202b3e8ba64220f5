"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key -ln(u) / quality, where u is fixed by its id and the seed, so documents of
higher quality come early. A source first gives as many complete epochs as fit in its target; then its documents
are taken in the order of their keys until the words left are reached, the last one in part. A source may be most
of the table: its keys are counted in BINS bins, a bin is cut into ranges of about RANGE_ROWS documents, ranges are
summed, and only rows inside a range are sorted together. Texts are read once; what follows works on written sizes
and keys. Sources and the running sums of a source's ranges are one small row each, a source's in one task.

Defined cases: null text has no words; null is a source of its own, the last; documents without words are taken
with 0 words; a source without words has target 0; rows repeated with their id tie and are ordered by size; rows
without an id draw by their text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import table, written

SEED = 17
#: Documents in a range of keys.
RANGE_ROWS = 1000
#: Bins in which a source's keys are counted, even in key / (1 + key), which has no empty tail.
BINS = 4096
#: Most often a document is taken.
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Between 0.05 and 1: less for texts in which marks of junk take much room."""
    marks = F.length(text) - F.length(F.translate(text, "#$%&*|!", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * F.coalesce(marks / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, source_rows to which weights 1, 2, 3, ... by code point and targets are added. One row a source.

    All sizes are shared by weight; a source stops at `most` times its size. With sources in the order of
    most * size / weight, those below a level are full and the rest share what is left by weight.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    up_to = by_level.rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    s = sources.withColumn("weight", (F.lit(1) + (F.row_number().over(by_name) - 1) % 3).cast("double"))
    s = s.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumns(
        {
            "all_size": F.sum("source_size").over(everything).cast("double"),
            "caps": F.sum("cap").over(up_to) - F.col("cap"),
            "weights_left": F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight"),
        }
    )
    s = s.withColumn("share", (F.col("all_size") - F.col("caps")) / F.col("weights_left"))
    # the first source, in order of levels, that is not full fixes the words for a unit of weight
    s = s.withColumn("unit", F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "share"))).over(everything)["share"])
    return s.select("source", "source_size", "source_rows", F.least("cap", F.col("weight") * F.coalesce("unit", F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = SEED, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row; taken counts repeats."""
    drawn = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit(seed), "doc_id")).otherwise(F.xxhash64(F.lit(seed), "text"))
    u = (F.pmod(drawn, F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rows = docs.select(
        "doc_id",
        "source",
        words(F.col("text")).alias("size"),
        (-F.log(u) / (quality(F.col("text")) if weight is None else weight)).alias("key"),
    )
    place = F.col("key") / (1 + F.col("key")) * BINS
    rows = written(rows, "mix-keys").withColumn("bin", F.floor(place).cast("long")).withColumn("within", place - F.floor(place))
    bins = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("bin_rows")), "mix-bins")
    sources = bins.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("bin_rows").alias("source_rows"))
    plan = targets(sources, most)
    p = plan.select(F.col("source").alias("_s"), "source_size", "target")
    p = bins.join(p, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("bin").alias("_b"), "bin_rows", "source_size", "target")
    # inside a bin keys are about even, so its rows are cut by where they are in it
    parts = F.greatest(F.lit(1), F.ceil(F.col("bin_rows") / range_rows))
    cut = F.struct("bin", F.floor(F.col("within") * parts).cast("long").alias("part"))
    keyed = rows.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b"))).drop("_s", "_b").withColumn("cut", cut)
    # running words of whole ranges, then inside each range
    ranges = keyed.groupBy("source", "cut").agg(F.sum("size").alias("words"))
    before = ranges.select(
        F.col("source").alias("_s"),
        F.col("cut").alias("_c"),
        (F.sum("words").over(W.partitionBy("source").orderBy("cut").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words")).alias("before"),
    )
    inside = W.partitionBy("source", "cut").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = keyed.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(before, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cut") == F.col("_c")))
    epochs = F.floor(F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)))
    left = F.round(F.col("target") - epochs * F.col("source_size")) - F.col("before") - F.col("inside")
    part = F.least(F.col("size"), F.greatest(F.lit(0), left.cast("long")))
    taken = F.least(epochs * F.col("size") + part, most * F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
