"""What was asked: modes of questions, adoption, latencies, gaps, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def question_modes(asked: DataFrame) -> DataFrame:
    """Of each query shape: how often, by how many, and the most frequent phrasing. asked: shape, user, question."""
    per = asked.where(F.col("question").isNotNull() & (F.trim("question") != "")).groupBy("shape", "question").agg(F.count(F.lit(1)).alias("n"))
    top = per.withColumn("r", F.row_number().over(W.partitionBy("shape").orderBy(F.desc("n"), "question"))).where("r = 1").select("shape", "question")
    own = asked.where(F.col("question").isNotNull() & (F.trim("question") != ""))
    counts = own.groupBy("shape").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("user").alias("askers"))
    return counts.join(top, "shape")


def adoption(audit: DataFrame) -> DataFrame:
    """user, role, asked, refused, metrics used. audit: user, role, metrics (array), refused."""
    own = audit.groupBy("user", "role").agg(F.count(F.when(~F.col("refused"), 1)).alias("asked"), F.count(F.when(F.col("refused"), 1)).alias("refused"))
    used = audit.select("user", "role", F.explode("metrics").alias("metric")).distinct().groupBy(F.col("user").alias("_user"), F.col("role").alias("_role")).agg(F.count("metric").alias("metrics_used"))
    at = F.col("user").eqNullSafe(F.col("_user")) & F.col("role").eqNullSafe(F.col("_role"))
    return own.join(used, at, "left").select("user", "role", "asked", "refused", F.coalesce("metrics_used", F.lit(0)).alias("metrics_used"))


def metric_usage(audit: DataFrame) -> DataFrame:
    return audit.where(~F.col("refused")).select(F.explode("metrics").alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("times"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95 and max by rank, over the counts of each group's values, which are added up before they are sorted."""
    w = W.partitionBy(*by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumns({"_to": F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    at = lambda p: F.min(F.when(F.col("_to") > F.floor(F.lit(p) * (F.col("_n") - 1)), F.col(value)))
    return ranked.groupBy(*by).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(value).alias("max"))


def latest(runs: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The n latest runs, of the same time the one with the greater key first."""
    return runs.orderBy(F.desc(time), F.desc(key)).limit(n)


def gap_rollup(gaps: DataFrame) -> DataFrame:
    """topic (lower case, one blank between words), customers and mentions. gaps: customer, text."""
    topic = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))
    return gaps.withColumn("topic", topic).where("topic != ''").groupBy("topic").agg(F.count_distinct("customer").alias("customers"), F.count(F.lit(1)).alias("mentions"))


def lineage(runs: DataFrame, table: str) -> DataFrame:
    """Runs whose state names the table among those it touched. runs: id, state (JSON)."""
    touched = F.from_json(F.get_json_object("state", "$.touched"), "array<string>")
    return runs.where(F.array_contains(touched, table))
