"""From raw documents to a training mix: each stage is written and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainloom.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from grainloom.llm.common import table, written


def aside(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with reserved names for the columns that a stage doesn't use, and the way back, so that no name meets one of a result."""
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), {v: c for c, v in names.items()}


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts.

    Null text counts as empty; documents without an id are scored too; repeated rows are judged alike; without labels of both
    kinds all stay; an empty table stays empty; other columns, whatever their names, pass through.
    """
    own, back = aside(docs, ("doc_id", "text", "lang", "source"))
    scored = quality.score(own, table(spark, sf_dir, "labels"), keep=tuple(own.columns))
    return scored.where("accepted").select(*own.columns).withColumnsRenamed(back)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; what has no line left goes.

    Null, empty and blank texts stay as they are, and so do documents without an id; rows that repeat an id are one document;
    an empty table stays empty; n_chars is counted anew where lines went; other columns pass through.
    """
    own, back = aside(docs, ("doc_id", "text", "n_chars"))
    out = line_dedup.line_dedup(own)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in own.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own.columns).withColumnsRenamed(back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard join, the one with the smallest id; of rows that repeat an id and its text, one.

    Documents without an id, text or words are linked with nothing and stay; an empty table stays empty; other columns pass through.
    """
    own, back = aside(docs, ("doc_id", "text"))
    groups = jaccard_join.jaccard_components(own)
    others = written(groups.where("component_id != doc_id").select(F.col("doc_id").alias("_other")).distinct(), "pipeline-others")
    repeated = own.where("doc_id is not null").groupBy(F.col("doc_id").alias("_other")).count().where("count > 1").select("_other")
    repeated = written(repeated, "pipeline-repeated")
    left = own.join(others, own["doc_id"] == others["_other"], "left_anti")
    if repeated.head(1):
        several = left.join(repeated, left["doc_id"] == repeated["_other"], "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, left["doc_id"] == repeated["_other"], "left_anti").unionByName(several)
    return left.select(*own.columns).withColumnsRenamed(back)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Null and empty texts are clean, and so is everything if the benchmark is empty; documents without an id are judged too;
    repeated rows are judged alike; an empty table stays empty; other columns pass through.
    """
    own, back = aside(docs, ("doc_id", "text"))
    found = decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark"), keep=tuple(own.columns))
    return found.where(~F.col("contaminated")).select(*own.columns).withColumnsRenamed(back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document.

    Null text has no words and none are taken; a null source is a source of its own; an empty table gives an empty result.
    """
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("line dedup", own_lines), ("jaccard join", one_of_each), ("decontamination", clean), ("mixing", mixed)]
#: The classifier and the sampling keys can't be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
