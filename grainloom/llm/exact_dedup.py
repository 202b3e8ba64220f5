"""Exact deduplication by sorting content.

Rows are dealt to partitions by sampled splitters over the first characters of the normalised text and its digest, so
that splitters are short whatever the texts are. Spark's external sort brings equal texts next to each other, and the
grouped window compares neighbours in full. A group of copies may be most of the table, so its rows are dealt by
(text, salt) first, with as many salts as partitions; the second sort sees one row for each text and salt.

Defined cases: null text counts as empty; all empty texts are copies of each other; a row without an id counts
in its group, and stays only if no row of the group has an id; of rows repeated with their id exactly one stays;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import partitions, table

#: Parts into which a group of copies is dealt, at least; characters of a text that splitters hold.
SALTS, PREFIX = 64, 16


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    n = partitions(docs.sparkSession)
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("_id"), F.monotonically_increasing_id())), F.lit(salts or max(SALTS, n)))
    rows = docs.select(F.col(id_col).alias("_id"), normalised(text_col).alias("_norm")).withColumns(
        {"_salt": salt.cast("int"), "_sha": F.sha2("_norm", 256), "_start": F.substring("_norm", 1, PREFIX)}
    )
    part = W.partitionBy("_start", "_sha", "_norm", "_salt")
    sorted_once = rows.repartitionByRange(n, "_start", "_sha", "_salt").select(
        "*",
        F.row_number().over(part.orderBy(F.col("_id").asc_nulls_last())).alias("_rank"),
        F.count(F.lit(1)).over(part).alias("_count"),
    )
    whole = W.partitionBy("_start", "_sha", "_norm")
    order = (F.col("_id").asc_nulls_last(), F.col("_salt"))
    firsts = (
        sorted_once.where("_rank = 1")
        .select("_id", "_norm", "_salt", "_sha", "_start", "_count")
        .repartitionByRange(n, "_start", "_sha")
        .select(
            F.col("_sha").alias("_sha2"),
            F.col("_salt").alias("_salt2"),
            F.first("_id").over(whole.orderBy(*order)).alias("keep_id"),
            F.sum("_count").over(whole).alias("group_size"),
            F.row_number().over(whole.orderBy(*order)).alias("_first"),
        )
    )
    # null-safe, so that no filter goes below one of the two uses of the first sort and Spark runs it once
    at = F.col("_sha").eqNullSafe(F.col("_sha2")) & F.col("_salt").eqNullSafe(F.col("_salt2"))
    return (
        sorted_once.select("_id", "_sha", "_salt", "_rank")
        .join(firsts, at)
        .select(
            F.col("_id").alias("doc_id"),
            "keep_id",
            "group_size",
            ((F.col("_rank") == 1) & (F.col("_first") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""
