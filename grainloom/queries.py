"""Named queries over the fixture model, each with the same in SQL that was written without the planner."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .cache import Results
from .catalog import Catalog
from .functions import age_seconds, code_tail, last_days, normalised, within
from .governance import Policy, Principal, RowRule, answer, spend_by_tenant
from .grounding import chained, filtered_by
from .guard import check_bytes
from .model import Model
from .operators import branch, checks, landing, merge, profile, usage
from .operators.nearest import nearest
from .operators.write import updated_from
from .plans.planner import plan
from .plans.query import Filter, SemanticQuery
from .rollout import simulated
from .state import StateTable, shared_dir
from .streaming import sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@lru_cache(maxsize=1)
def model() -> Model:
    return Model.load(os.path.join(os.path.dirname(__file__), "tpch_model.yaml"))


def tidy(df: DataFrame) -> DataFrame:
    """Decimals of doubles are cut to 4, so that the order of a sum doesn't show."""
    return df.select(*(F.round(F.col(f.name), 4).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.DecimalType)) else F.col(f.name) for f in df.schema.fields))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Catalog(spark, sf_dir).table(name)


def resolver(spark: SparkSession, sf_dir: str):
    return Catalog(spark, sf_dir).resolver(model())


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def metric(name: str, sql: str, metrics: str, by: str = "", **how) -> None:
    """A query of the model; metrics and by are names with blanks between."""
    q = SemanticQuery(tuple(metrics.split()), tuple(by.split()), **how)
    QUERIES[name] = lambda spark, sf_dir: tidy(plan(model(), q, resolver(spark, sf_dir)))
    ORACLE[name] = sql


L = "lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"
C = "customer c JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey"
REV = "round(sum(l_extendedprice * (1 - l_discount)), 4)"

# base aggregates
metric("sum_global", f"SELECT {REV} AS revenue FROM lineitem", "revenue")
metric("count_global", "SELECT CAST(count(l_orderkey) AS BIGINT) AS line_count FROM lineitem", "line_count")
metric("count_distinct_global", "SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS order_count FROM orders", "order_count")
metric("avg_by_dim", "SELECT l_returnflag AS return_flag, round(avg(l_discount), 4) AS avg_discount FROM lineitem GROUP BY 1", "avg_discount", "return_flag")
metric("sum_by_1hop", f"SELECT p_brand AS brand, {REV} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1", "revenue", "brand")
metric("sum_by_2hop", "SELECT c_mktsegment AS segment, round(sum(l_quantity), 4) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1", "quantity", "segment")
metric("sum_by_3hop", f"SELECT r_name AS customer_region, {REV} AS revenue FROM {L} GROUP BY 1", "revenue", "customer_region")
metric("conditional_sum", "SELECT l_linestatus_ AS order_status, round(sum(q), 4) AS returned_quantity FROM (SELECT o_orderstatus AS l_linestatus_, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1", "returned_quantity", "order_status")
# several metrics, synonyms, dimensions
metric("two_metrics_same_base", f"SELECT l_returnflag AS return_flag, {REV} AS revenue, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1", "revenue quantity", "return_flag")
metric("two_dims", f"SELECT r_name AS customer_region, c_mktsegment AS segment, {REV} AS revenue FROM {L} GROUP BY 1, 2", "revenue", "customer_region segment")
metric("synonym_query", f"SELECT n_name AS customer_nation, {REV} AS revenue FROM {L} GROUP BY 1", "turnover", "country")
metric("roles_two_regions", f"SELECT r.r_name AS customer_region, r2.r_name AS supplier_region, {REV} AS revenue FROM {L} JOIN supplier s ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey JOIN region r2 ON n2.n_regionkey = r2.r_regionkey GROUP BY 1, 2", "revenue", "customer_region supplier_region")
metric("order_value_by_region_not_inflated", "SELECT r_name AS customer_region, round(sum(o_totalprice), 4) AS order_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", "order_value", "customer_region")
metric("labels_by_source", "SELECT source AS doc_source, CAST(count(l.doc_id) AS BIGINT) AS label_count, CAST(sum(toxic) AS BIGINT) AS toxic_labels FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1", "label_count toxic_labels", "doc_source")
# filters
metric("filter_eq", f"SELECT r_name AS customer_region, {REV} AS revenue FROM {L} WHERE c_mktsegment = 'BUILDING' GROUP BY 1", "revenue", "customer_region", where=(Filter("segment", "=", ("BUILDING",)),))
metric("filter_ne", f"SELECT l_returnflag AS return_flag, {REV} AS revenue FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1", "revenue", "return_flag", where=(Filter("return_flag", "!=", ("N",)),))
metric("filter_in", "SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS order_count FROM orders WHERE o_orderstatus IN ('O', 'P')", "order_count", where=(Filter("order_status", "in", ("O", "P")),))
metric("filter_range_time", "SELECT round(sum(o_totalprice), 4) AS order_value FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'", "order_value", where=(Filter("order_date", ">=", ("1996-01-01",)), Filter("order_date", "<", ("1997-01-01",))))
metric("filter_two_hops", f"SELECT p_brand AS brand, {REV} AS revenue FROM {L} JOIN part ON l_partkey = p_partkey WHERE r_name = 'ASIA' GROUP BY 1", "revenue", "brand", where=(Filter("customer_region", "=", ("ASIA",)),))
metric("filter_bounds", "SELECT CAST(count(l_orderkey) AS BIGINT) AS line_count FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-03-01' AND l_shipdate <= TIMESTAMP '1998-03-01'", "line_count", where=(Filter("ship_date", ">", ("1996-03-01",)), Filter("ship_date", "<=", ("1998-03-01",))))
# grains
for g in ("day", "week", "month", "quarter", "year"):
    metric(f"grain_{g}", f"SELECT CAST(date_trunc('{g}', o_orderdate) AS DATE) AS order_date, round(sum(o_totalprice), 4) AS order_value FROM orders GROUP BY 1", "order_value", "order_date", time_grain=g)
# several facts
SIDES = """WITH a AS (SELECT {k} AS k, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM {l} GROUP BY 1),
e AS (SELECT {ke} AS k, sum(value) AS v FROM events JOIN customer c ON user_id = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1)
SELECT coalesce(a.k, e.k) AS {name}, revenue, round(v, 4) AS event_value FROM a FULL JOIN e ON a.k IS NOT DISTINCT FROM e.k"""
metric("chasm_events_orders_by_segment", SIDES.format(k="c_mktsegment", ke="c_mktsegment", l=L, name="segment"), "revenue event_value", "segment")
metric("drill_gap_null_side", """WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 4) AS order_value FROM orders GROUP BY 1),
e AS (SELECT user_id AS k, CAST(count(event_id) AS BIGINT) AS event_count FROM events GROUP BY 1)
SELECT coalesce(a.k, e.k) AS customer_key, order_value, event_count FROM a FULL JOIN e ON a.k IS NOT DISTINCT FROM e.k""", "order_value event_count", "customer_key")
metric("ratio_cross_grain_by_region", f"""WITH e AS (SELECT r_name AS k, sum(value) AS v FROM events JOIN customer c ON user_id = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey GROUP BY 1),
c AS (SELECT r_name AS k, count(c_custkey) AS n FROM {C} GROUP BY 1)
SELECT coalesce(e.k, c.k) AS customer_region, round(v / nullif(n, 0), 4) AS value_per_customer FROM e FULL JOIN c ON e.k IS NOT DISTINCT FROM c.k""", "value_per_customer", "customer_region")
metric("ratio_cross_grain_global", "SELECT round((SELECT count(event_id) FROM events) / nullif((SELECT count(DISTINCT o_orderkey) FROM orders), 0), 4) AS events_per_order", "events_per_order")
metric("derived_ratio", "SELECT l_returnflag AS return_flag, round((sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount))) / nullif(sum(l_extendedprice), 0), 4) AS discount_rate FROM lineitem GROUP BY 1", "discount_rate", "return_flag")
metric("derived_difference", f"SELECT r_name AS customer_region, round(sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)), 4) AS discount_given FROM {L} GROUP BY 1", "discount_given", "customer_region")
metric("nested_derived", "SELECT round(2 * (sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount))) / nullif(sum(l_extendedprice), 0), 4) AS double_discount_rate FROM lineitem", "double_discount_rate")
metric("avg_order_revenue", f"SELECT c_mktsegment AS segment, round(sum(l_extendedprice * (1 - l_discount)) / nullif(count(DISTINCT l_orderkey), 0), 4) AS avg_order_revenue FROM {L} GROUP BY 1", "avg_order_revenue", "segment")
metric("purchase_share", "SELECT c_mktsegment AS segment, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / nullif(sum(value), 0), 4) AS purchase_share FROM events JOIN customer ON user_id = c_custkey GROUP BY 1", "purchase_share", "segment")
# windows
M = "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS t, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT t AS order_date, round({}, 4) AS {} FROM m"
for name, window, column in (
    ("rolling3_month", "sum(v) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "revenue_rolling_3"),
    ("cumulative_month", "sum(v) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING)", "revenue_cumulative"),
    ("ytd_reset", "sum(v) OVER (PARTITION BY date_trunc('year', t) ORDER BY t ROWS UNBOUNDED PRECEDING)", "revenue_ytd"),
    ("delta_month", "v - lag(v) OVER (ORDER BY t)", "revenue_delta"),
    ("prior_month", "lag(v) OVER (ORDER BY t)", "revenue_prior"),
):
    metric(name, M.format(window, column), column, "order_date", time_grain="month")
metric("rolling3_by_segment", "WITH m AS (SELECT c_mktsegment AS s, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS t, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT s AS segment, t AS order_date, round(sum(v) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS revenue_rolling_3 FROM m", "revenue_rolling_3", "segment order_date", time_grain="quarter")
# top-k
metric("top_n_by_metric", f"SELECT n_name AS customer_nation, {REV} AS revenue FROM {L} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", "revenue", "customer_nation", order_by=(("revenue", True), ("customer_nation", False)), limit=5)


@query("label_only_top_n", f"SELECT customer_nation FROM (SELECT n_name AS customer_nation, {REV} AS v FROM {L} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def _(spark, d):
    q = SemanticQuery(("revenue",), ("customer_nation",), order_by=(("revenue", True), ("customer_nation", False)), limit=3)
    return plan(model(), q, resolver(spark, d)).select("customer_nation")


@query("chain_top_region_then_metric", f"WITH t AS (SELECT r_name FROM {L} GROUP BY 1 ORDER BY sum(l_extendedprice * (1 - l_discount)) DESC, 1 LIMIT 1) SELECT c_mktsegment AS segment, {REV} AS revenue FROM {L} WHERE r_name = (SELECT r_name FROM t) GROUP BY 1")
def _(spark, d):
    r = resolver(spark, d)
    top = SemanticQuery(("revenue",), ("customer_region",), order_by=(("revenue", True), ("customer_region", False)), limit=1)
    return chained([("top", lambda _: plan(model(), top, r)), ("", lambda known: plan(model(), SemanticQuery(("revenue",), ("segment",), where=filtered_by("customer_region", known["top"])), r))])


# governance
POLICY = Policy(row_rules=(RowRule(("manager",), "customer_region", "region"),), k=5, count_metric="customer_count", protected=("customer_nation", "customer_name"))
MANAGER, ANALYST = Principal("m", "manager", {"region": "ASIA"}), Principal("a", "analyst")


@query("rls_region_scoped", f"SELECT c_mktsegment AS segment, {REV} AS revenue FROM {L} WHERE r_name = 'ASIA' GROUP BY 1")
def _(spark, d):
    return answer(model(), SemanticQuery(("revenue",), ("segment",)), POLICY, MANAGER, resolver(spark, d))


@query("session_predicate_scoped", "SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS order_count FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    scoped = Catalog(spark, d).resolver(model(), {"order": F.col("o_orderstatus") == "F"})
    return plan(model(), SemanticQuery(("order_count",)), scoped)


@query("k_anon_suppressed", "SELECT n_name AS customer_nation, c_mktsegment AS segment, round(sum(c_acctbal), 4) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING count(c_custkey) >= 12")
def _(spark, d):
    policy = Policy(k=12, count_metric="customer_count", protected=("customer_nation",), exempt_roles=())
    return answer(model(), SemanticQuery(("balance",), ("customer_nation", "segment")), policy, Principal("f", "finance"), resolver(spark, d))


@query("masked_dimension", "SELECT '***' AS customer_name, c_mktsegment AS segment, CAST(count(c_custkey) AS BIGINT) AS customer_count FROM customer GROUP BY c_name, c_mktsegment")
def _(spark, d):
    return answer(model(), SemanticQuery(("customer_count",), ("customer_name", "segment")), Policy(), ANALYST, resolver(spark, d))


@query("k_anon_then_mask", "SELECT '***' AS customer_name, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS order_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name HAVING count(DISTINCT o_orderkey) >= 10")
def _(spark, d):
    policy = Policy(k=10, count_metric="order_count", protected=("customer_name",))
    return answer(model(), SemanticQuery(("order_count",), ("customer_name",)), policy, ANALYST, resolver(spark, d))


@query("byte_ceiling_passed", "SELECT CAST(count(event_id) AS BIGINT) AS event_count FROM events")
def _(spark, d):
    df = plan(model(), SemanticQuery(("event_count",)), resolver(spark, d))
    check_bytes(df, 1 << 40)
    return df


# integrity and profiles
@query("orphans_declared", "SELECT CAST(count(l_orderkey) AS BIGINT) AS total, CAST(count(CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) THEN 1 END) AS BIGINT) AS orphans FROM lineitem WHERE l_orderkey IS NOT NULL")
def _(spark, d):
    return profile.orphans(table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders"), "o_orderkey")


@query("orphans_implied", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(CASE WHEN c_custkey NOT IN (SELECT user_id FROM events) THEN 1 END) AS BIGINT) AS orphans FROM customer")
def _(spark, d):
    return profile.orphans(table(spark, d, "customer"), "c_custkey", table(spark, d, "events"), "user_id")


@query("duplicate_keys_lineitem", "SELECT CAST(0 AS BIGINT) AS null_keys, CAST(count(*) AS BIGINT) AS repeated_keys FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def _(spark, d):
    return landing.key_faults(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def stats_sql(what: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {what.format(c=c)} FROM orders" for c in PROFILED)


@query("null_rates", stats_sql("round(count(*) FILTER ({c} IS NULL) / count(*), 3) AS null_rate"))
def _(spark, d):
    s = profile.column_stats(table(spark, d, "orders").select(*PROFILED))
    return s.select(F.col("column").alias("column_name"), F.round(F.col("nulls") / F.col("rows"), 3).alias("null_rate"))


@query("distinct_counts", stats_sql("CAST(count(DISTINCT {c}) AS BIGINT) AS n"))
def _(spark, d):
    return profile.column_stats(table(spark, d, "orders").select(*PROFILED)).select(F.col("column").alias("column_name"), F.col("distinct").alias("n"))


@query("minmax_time", "SELECT CAST(min(ts) AS VARCHAR) AS low, CAST(max(ts) AS VARCHAR) AS high FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    return e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("low"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("high"))


@query("code_columns", "SELECT 'l_linenumber' AS column_name, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS n, CAST(min(l_linenumber) AS BIGINT) AS low, CAST(max(l_linenumber) AS BIGINT) AS high FROM lineitem UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey), min(l_orderkey), max(l_orderkey) FROM lineitem")
def _(spark, d):
    return profile.code_stats(table(spark, d, "lineitem").select("l_linenumber", "l_orderkey")).select(F.col("column").alias("column_name"), F.col("distinct").alias("n"), "low", "high")


@query("segment_gaps_orders", """WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P' OR o_orderdate < TIMESTAMP '1999-01-01'),
e AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM o),
g AS (SELECT o_orderstatus AS segment, CAST(max(o_orderdate) AS DATE) AS last, CAST(count(*) AS BIGINT) AS "rows" FROM o GROUP BY 1 HAVING count(*) >= 3)
SELECT segment, last, "rows", CAST(date_diff('day', last, d) AS INTEGER) AS days_behind FROM g, e WHERE date_diff('day', last, d) >= 60""")
def _(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderstatus") != "P") | (F.col("o_orderdate") < "1999-01-01"))
    return profile.segment_gaps(o, "o_orderdate", "o_orderstatus")


# branches
BRANCH = """WITH m AS (SELECT count(*) AS r, sum(o_totalprice) AS s FROM orders), b AS (SELECT count(*) AS r, coalesce(sum(v), 0) AS s FROM ({})),
x AS (SELECT '_rows' AS measure, CAST(m.r AS DOUBLE) AS main, CAST(b.r AS DOUBLE) AS branch FROM m, b UNION ALL SELECT 'o_totalprice', round(m.s, 4), round(b.s, 4) FROM m, b)
SELECT *, CASE WHEN main = 0 THEN CASE WHEN branch = 0 THEN 0.0 ELSE 100.0 END ELSE round((branch - main) / main * 100, 2) END AS pct FROM x"""
for name, change, sql in (
    ("branch_diff_doubled", lambda o: o.unionAll(o), "SELECT o_totalprice AS v FROM orders UNION ALL SELECT o_totalprice FROM orders"),
    ("branch_diff_units", lambda o: o.withColumn("o_totalprice", F.col("o_totalprice") * 100), "SELECT o_totalprice * 100 AS v FROM orders"),
    ("branch_diff_missing", lambda o: o.where("o_orderstatus != 'F'"), "SELECT o_totalprice AS v FROM orders WHERE o_orderstatus <> 'F'"),
):
    query(name, BRANCH.format(sql))(lambda spark, d, change=change: branch.diff(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), change(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")), ("o_orderkey",)))


# merging: an import that shares two thirds of the customers, with other balances and names
def two_sides(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).cast("decimal(12,2)").alias("balance"), F.col("c_mktsegment").alias("segment"))
    crm = c.where("id % 3 != 0").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    new = c.where("id % 3 != 1").select("id", F.concat("name", F.when(F.col("id") % 2 == 0, F.lit(" Ltd")).otherwise(F.lit(""))).alias("name"), (F.col("balance") + F.col("id") % 5 - 2).cast("decimal(12,2)").alias("balance"), "segment")
    return crm, new.withColumn("at", F.when(F.col("id") % 4 == 0, F.lit("2023-01-01").cast("timestamp_ntz")).otherwise(F.lit("2024-06-01").cast("timestamp_ntz")))


SIDE = """WITH c AS (SELECT c_custkey AS id, c_name AS name, CAST(round(c_acctbal, 2) AS DECIMAL(12,2)) AS balance FROM customer),
e AS (SELECT * FROM c WHERE id % 3 <> 0),
i AS (SELECT id, name || CASE WHEN id % 2 = 0 THEN ' Ltd' ELSE '' END AS name, CAST(balance + id % 5 - 2 AS DECIMAL(12,2)) AS balance, id % 4 <> 0 AS newer FROM c WHERE id % 3 <> 1),
j AS (SELECT coalesce(e.id, i.id) AS id, e.name AS en, i.name AS n, e.balance AS eb, i.balance AS ib, newer FROM e FULL JOIN i ON e.id = i.id)
"""


def merged(field: str, strategy: str, **how):
    def f(spark, d):
        a, b = two_sides(spark, d)
        return merge.merge(a, b, "id", [merge.Rule(field, strategy)], time="at", **how).select("id", field)

    return f


query("merge_latest", SIDE + "SELECT id, CASE WHEN en IS NULL THEN n WHEN n IS NULL THEN en WHEN newer THEN n ELSE en END AS name FROM j")(merged("name", "latest"))
query("merge_max", SIDE + "SELECT id, CAST(CASE WHEN eb IS NULL THEN ib WHEN ib IS NULL THEN eb ELSE greatest(eb, ib) END AS VARCHAR) AS balance FROM j")(merged("balance", "max"))
query("merge_min", SIDE + "SELECT id, CAST(CASE WHEN eb IS NULL THEN ib WHEN ib IS NULL THEN eb ELSE least(eb, ib) END AS VARCHAR) AS balance FROM j")(merged("balance", "min"))
query("merge_longest", SIDE + "SELECT id, CASE WHEN en IS NULL OR length(n) > length(en) THEN n ELSE en END AS name FROM j")(merged("name", "longest"))
query("merge_keep_existing", SIDE + "SELECT id, coalesce(en, n) AS name FROM j")(merged("name", "keep_existing"))
query("merge_source_priority", SIDE + "SELECT id, coalesce(n, en) AS name FROM j")(merged("name", "source_priority", priority=("crm", "import", ("import", "crm"))))


@query("merge_events_changed", SIDE + "SELECT id, 'name' AS field, 'alert' AS kind, 'warning' AS severity, en || ' -> ' || n AS message FROM j WHERE en IS NOT NULL AND n IS NOT NULL AND en <> n")
def _(spark, d):
    a, b = two_sides(spark, d)
    return merge.events(merge.merge(a, b, "id", [merge.Rule("name", "prefer_incoming", alert="changed")]), "id").where("kind = 'alert'")


# conflict checks
@query("theta_residual_check", "SELECT l_orderkey, l_partkey, round(l_quantity, 4) AS l_quantity, round(p_retailprice, 4) AS listed FROM lineitem JOIN part ON l_partkey = p_partkey WHERE abs(l_extendedprice / nullif(l_quantity, 0) - p_retailprice) > 1500")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    paid = F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))
    return j.where(F.abs(paid - F.col("p_retailprice")) > 1500).select("l_orderkey", "l_partkey", "l_quantity", F.col("p_retailprice").alias("listed"))


@query("sold_without_stock_check", "SELECT p_partkey, round(sum(l_quantity), 4) AS sold FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT p_partkey AS k, p_size AS stock FROM part WHERE p_size > 10) s ON p_partkey = s.k GROUP BY p_partkey HAVING coalesce(max(stock), 0) = 0 AND sum(l_quantity) > 100")
def _(spark, d):
    sold = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("sold"))
    stock = table(spark, d, "part").where("p_size > 10").select("p_partkey", F.col("p_size").alias("stock"))
    known = sold.join(table(spark, d, "part").select("p_partkey"), "p_partkey", "left_semi")
    return known.join(stock, "p_partkey", "left").where((F.coalesce("stock", F.lit(0)) == 0) & (F.col("sold") > 100)).select("p_partkey", "sold")


@query("left_join_null_check", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def _(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("update_from", "SELECT p_partkey, round(CASE WHEN p_partkey % 7 = 0 THEN p_retailprice * 1.1 ELSE p_retailprice END, 4) AS p_retailprice FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return updated_from(p, p.where("p_partkey % 7 = 0").withColumn("p_retailprice", F.col("p_retailprice") * 1.1), "p_partkey", ["p_retailprice"])


# landing
def staged(spark, d):
    o = table(spark, d, "orders")
    odd = F.col("o_orderkey") % 10
    return o.select(
        F.when(odd == 3, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("id"),
        F.when(odd == 4, F.lit("999999999")).otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(odd == 5, F.lit("n/a")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(odd == 6, F.lit("")).otherwise(F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string")).alias("amount"),
    )


@query("landing_gate_valid", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 10 = 4 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer, CASE WHEN o_orderkey % 10 = 5 THEN 'n/a' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 10 = 6 THEN NULL ELSE CAST(round(o_totalprice, 2) AS DECIMAL(12,2)) END AS amount FROM orders WHERE o_orderkey % 10 <> 3")
def _(spark, d):
    return landing.gate(staged(spark, d), "id", {"id": "bigint", "amount": "decimal(12,2)"}, optional_refs={"customer": (table(spark, d, "customer"), "c_custkey")})


@query("landing_gate_rejected", "SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS id, 'missing amount' AS reason FROM orders WHERE o_orderkey % 10 = 6")
def _(spark, d):
    m = landing.mapping(["id", "customer", "status", "amount"], required=("id", "amount"), tags={"_batch": "b1"})
    return landing.rejected(landing.mapped(staged(spark, d), m)).select("id", F.col("_reason").alias("reason"))


@query("upsert_ignore_existing", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    new = c.where("id % 2 = 0").withColumn("segment", F.lit("NEW"))
    return landing.upserted(new.unionAll(new), c.where("id % 3 != 0"), ["id"])


@query("distinct_on_first", "SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1".replace("o_orderdate, o_orderkey FROM (", "CAST(o_orderdate AS DATE) AS o_orderdate, o_orderkey FROM ("))
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return landing.first_per_key(o, ["o_custkey"]).select("o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderkey")


@query("json_flatten_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def _(spark, d):
    from .sources.scan import flatten

    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return flatten(e)


# usage, over rows made of events
def asked(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("user"),
        F.when(F.col("user_id") % 3 == 0, "manager").otherwise("analyst").alias("role"),
        F.array(F.col("event_type"), F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string"))).alias("metrics"),
        (F.col("event_id") % 11 == 0).alias("refused"),
        F.col("event_type").alias("shape"),
        F.concat(F.lit("show "), F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " please").otherwise("")).alias("question"),
        F.col("value").alias("ms"),
    )


@query("adoption_by_user", "WITH a AS (SELECT 'u' || CAST(user_id % 20 AS VARCHAR) AS \"user\", CASE WHEN user_id % 3 = 0 THEN 'manager' ELSE 'analyst' END AS role, event_type AS x, 'm' || CAST(event_id % 4 AS VARCHAR) AS y, event_id % 11 = 0 AS refused FROM events), u AS (SELECT \"user\", role, x AS m FROM a UNION SELECT \"user\", role, y FROM a), m AS (SELECT \"user\", role, count(DISTINCT m) AS n FROM u GROUP BY 1, 2) SELECT a.\"user\", a.role, CAST(count(*) FILTER (NOT refused) AS BIGINT) AS asked, CAST(count(*) FILTER (refused) AS BIGINT) AS refused, CAST(max(m.n) AS BIGINT) AS metrics_used FROM a JOIN m ON a.\"user\" = m.\"user\" AND a.role = m.role GROUP BY 1, 2")
def _(spark, d):
    return usage.adoption(asked(spark, d))


@query("question_modes", "WITH a AS (SELECT event_type AS shape, user_id % 20 AS u, 'show ' || event_type || CASE WHEN event_id % 3 = 0 THEN ' please' ELSE '' END AS q FROM events), c AS (SELECT shape, q, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT shape, q, row_number() OVER (PARTITION BY shape ORDER BY n DESC, q) AS r FROM c) SELECT a.shape, CAST(count(*) AS BIGINT) AS times, CAST(count(DISTINCT u) AS BIGINT) AS askers, max(t.q) AS question FROM a JOIN t ON a.shape = t.shape AND r = 1 GROUP BY 1")
def _(spark, d):
    return usage.question_modes(asked(spark, d))


@query("latency_percentiles", "WITH r AS (SELECT event_type AS shape, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT shape, round(max(CASE WHEN i = floor(0.5 * (n - 1)) THEN value END), 4) AS p50, round(max(CASE WHEN i = floor(0.95 * (n - 1)) THEN value END), 4) AS p95, round(max(value), 4) AS max FROM r GROUP BY 1")
def _(spark, d):
    return usage.latency(asked(spark, d), "ms", "shape")


@query("gap_rollup", "SELECT 'show ' || event_type AS topic, CAST(count(DISTINCT user_id) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS mentions FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("customer"), F.concat(F.lit("Show "), F.upper("event_type"), F.lit("?!")).alias("text"))
    return usage.gap_rollup(e)


@query("usage_by_metric", "SELECT m AS metric, CAST(count(*) AS BIGINT) AS times FROM (SELECT event_type AS m FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT 'm' || CAST(event_id % 4 AS VARCHAR) FROM events WHERE event_id % 11 <> 0) GROUP BY 1")
def _(spark, d):
    return usage.metric_usage(asked(spark, d))


@query("simulated_routing", "WITH k AS (SELECT 'user-' || CAST(range AS VARCHAR) AS k FROM range(10000)), b AS (SELECT list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 100 AS b FROM k) SELECT CASE WHEN b < 20 THEN 'canary' ELSE 'active' END AS version, CAST(count(*) AS BIGINT) AS keys FROM b GROUP BY 1")
def _(spark, d):
    return simulated(spark, 10_000, 20)


@query("question_accuracy", "WITH c AS (SELECT event_type AS category, event_id % 4 AS want, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 5 END AS got FROM events) SELECT category, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (want = got) AS BIGINT) AS \"right\", CAST(count(*) FILTER (want <> got) AS BIGINT) AS wrong, CAST(count(*) FILTER (got IS NULL) AS BIGINT) AS refused, round(avg(CASE WHEN want = got THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM c GROUP BY 1")
def _(spark, d):
    return checks.graded(cases(spark, d))


@query("question_confusion", "WITH c AS (SELECT event_id % 4 AS want, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 5 END AS got FROM events) SELECT want, got, CAST(count(*) AS BIGINT) AS cases FROM c GROUP BY 1, 2")
def _(spark, d):
    return checks.confusion(cases(spark, d))


def cases(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("category"), (F.col("event_id") % 4).alias("want"), F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 5).alias("got"))


@query("spend_by_tenant", "SELECT 't' || CAST(user_id % 7 AS VARCHAR) AS tenant, round(sum(value), 4) AS spent FROM events GROUP BY 1")
def _(spark, d):
    spend = table(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")).alias("tenant"), F.col("value").alias("amount"))
    return spend_by_tenant(spend)


@query("latest_runs", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def _(spark, d):
    return usage.latest(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 20).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


# expressions of dates and codes
@query("half_open_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-31' AND o_orderdate < DATE '1996-01-31' + INTERVAL 1 MONTH + INTERVAL 3 DAY")
def _(spark, d):
    return table(spark, d, "orders").where(within(F.col("o_orderdate"), F.lit("1996-01-31").cast("date"), days=3, months=1)).select("o_orderkey")


@query("last_thirty_days", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-15' - 30 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-15'")
def _(spark, d):
    return table(spark, d, "orders").where(last_days(F.col("o_orderdate"), F.lit("1997-06-15").cast("date"), 30)).select("o_orderkey")


@query("event_age", "SELECT event_id, CAST(floor(epoch(TIMESTAMP '2025-01-01 00:00:00')) - floor(epoch(ts)) AS BIGINT) AS age FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", age_seconds(F.col("ts"), F.lit("2025-01-01 00:00:00")).alias("age"))


@query("code_parts", "SELECT c_custkey, substr(c_name, 5) AS tail, split_part(c_mktsegment || ':' || c_name, ':', 2) AS part FROM customer")
def _(spark, d):
    key = F.concat_ws(":", "c_mktsegment", "c_name")
    return table(spark, d, "customer").select("c_custkey", code_tail(F.col("c_name"), 4).alias("tail"), F.split_part(key, F.lit(":"), F.lit(2)).alias("part"))


@query("lineage_of_table", "SELECT event_id AS id FROM events WHERE event_type = 'click' OR event_id % 5 = 0")
def _(spark, d):
    e = table(spark, d, "events")
    touched = F.when(F.col("event_id") % 5 == 0, F.array(F.lit("orders"), F.col("event_type"))).when(F.col("event_type") == "click", F.array(F.lit("orders"))).otherwise(F.array(F.col("event_type")))
    return usage.lineage(e.select(F.col("event_id").alias("id"), F.to_json(F.struct(touched.alias("touched"))).alias("state")), "orders").select("id")


@query("semi_join_references", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(spark, d):
    large = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey")


@query("inferred_types", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS BIGINT) AS customer, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS ordered, '0' || CAST(o_orderkey AS VARCHAR) AS code, o_orderkey % 2 = 0 AS even FROM orders")
def _(spark, d):
    from .sources.infer import infer, typed

    o = table(spark, d, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(" ")).otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
        F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("code"),
        F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("f").alias("even"),
    )
    return typed(text, infer(text)).withColumn("ordered", F.to_date("ordered"))


@query("csv_scan", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    from .sources.scan import csv

    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return csv(spark, path)


# last values: of several rows at the latest time, the greatest value
metric("last_value_by_dim", "WITH m AS (SELECT c_mktsegment AS segment, o_orderdate AS t, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey), l AS (SELECT segment, max(t) AS t FROM m GROUP BY 1) SELECT m.segment, round(max(v), 4) AS last_order_value FROM m JOIN l ON m.segment = l.segment AND m.t = l.t GROUP BY 1", "last_order_value", "segment")


def axis_cases(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.array(F.lit("revenue"), F.col("event_type")).alias("want_metrics"), F.array(F.when(F.col("event_id") % 5 == 0, "orders").otherwise(F.col("event_type")), F.lit("revenue")).alias("got_metrics"),
        F.when(F.col("event_id") % 2 == 0, "month").alias("want_grain"), F.when(F.col("event_id") % 6 != 1, F.when(F.col("event_id") % 2 == 0, "month")).otherwise("day").alias("got_grain"),
    )


@query("question_axes", "SELECT CAST(event_id AS VARCHAR) AS id, event_id % 5 <> 0 OR event_type = 'orders' AS metrics_ok, event_id % 6 <> 1 AS grain_ok, (event_id % 5 <> 0 OR event_type = 'orders') AND event_id % 6 <> 1 AS ok FROM events")
def _(spark, d):
    return checks.axes(axis_cases(spark, d))


def runs(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), "event_id")
    first = e.where("event_id % 7 != 0").select(F.lit(1).cast("long").alias("run"), "id", F.lit("all").alias("category"), (F.col("event_id") % 3 != 0).alias("ok"))
    return first.union(e.where("event_id % 11 != 0").select(F.lit(2).cast("long"), "id", F.lit("all"), F.col("event_id") % 4 != 0))


@query("run_changes", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 7 = 0 THEN 'new' WHEN event_id % 11 = 0 THEN 'gone' WHEN event_id % 3 <> 0 THEN 'broken' ELSE 'mended' END AS change FROM events WHERE NOT (event_id % 7 = 0 AND event_id % 11 = 0) AND (event_id % 7 = 0 OR event_id % 11 = 0 OR (event_id % 3 <> 0) <> (event_id % 4 <> 0))")
def _(spark, d):
    return checks.between_runs(runs(spark, d), 1, 2)


@query("run_history", "SELECT CAST(1 AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS cases, round(avg(CASE WHEN event_id % 3 <> 0 THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 2, CAST(count(*) AS BIGINT), round(avg(CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.0 END), 4) FROM events WHERE event_id % 11 <> 0")
def _(spark, d):
    return checks.history(runs(spark, d))


@query("survey_summary", "SELECT 'customer' AS \"table\", CAST(count(*) AS BIGINT) AS rows, CAST(5 AS BIGINT) AS columns, CAST(5 * count(*) - count(c_custkey) - count(c_name) - count(c_nationkey) - count(c_acctbal) - count(c_mktsegment) AS BIGINT) AS nulls, CAST(0 AS BIGINT) AS empty_columns, CAST(0 AS BIGINT) AS constant_columns FROM customer UNION ALL SELECT 'events', CAST(count(*) AS BIGINT), 4, CAST(4 * count(*) - 2 * count(event_id) - count(event_type) AS BIGINT), 1, 1 FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.lit("x").alias("same"), F.lit(None).cast("long").alias("void"))
    e = e.withColumn("same", F.when(F.col("event_id").isNotNull(), F.col("same")))
    return profile.summary(profile.surveyed({"customer": table(spark, d, "customer"), "events": e}))


@query("date_evidence", "WITH v AS (SELECT 'day' AS \"column\", CASE WHEN o_orderkey % 9 = 0 THEN 'soon' WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders UNION ALL SELECT 'code', strftime(o_orderdate, '%Y%m%d') FROM orders), x AS (SELECT unnest(['yyyy-MM-dd', 'yyyyMMdd']) AS layout) SELECT \"column\", layout, CAST(count(value) AS BIGINT) AS filled, CAST(count(CASE WHEN (layout = 'yyyyMMdd' AND \"column\" = 'code') OR (layout = 'yyyy-MM-dd' AND \"column\" = 'day' AND value <> 'soon') THEN value END) AS BIGINT) AS dates FROM v, x GROUP BY 1, 2")
def _(spark, d):
    from .sources.infer import date_evidence

    day = F.when(F.col("o_orderkey") % 9 == 0, "soon").when(F.col("o_orderkey") % 4 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return date_evidence(table(spark, d, "orders").select(day.alias("day"), F.date_format("o_orderdate", "yyyyMMdd").alias("code")))


@query("stale_answer", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, 'stale' AS label FROM events GROUP BY 1")
def _(spark, d):
    now = [datetime(2024, 1, 1)]
    results = Results(spark, timedelta(minutes=5), timedelta(hours=1), lambda: now[0])
    results.get("k", lambda: table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    now[0] += timedelta(minutes=6)
    got = results.get("k", lambda: table(spark, d, "no_such_table"))
    return got.rows.withColumn("label", F.lit(got.label))


@query("stream_tail_start", "SELECT event_id, event_type FROM events WHERE event_id >= (SELECT max(event_id) // 2 FROM events)")
def _(spark, d):
    tmp = f"{shared(spark)}/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type")
    state = StateTable(spark, f"{tmp}/cursors", sync.CURSORS)
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    sync.tail(e.where(F.col("event_id") <= half), "events", "event_id", state)
    sync.sync(e, "events", "event_id", ["event_id"], f"{tmp}/events", state)
    return spark.read.parquet(f"{tmp}/events")


# streaming
@query("pending_rows", "SELECT CAST(count(*) AS BIGINT) AS pending FROM events WHERE date_trunc('second', ts) > (SELECT max(date_trunc('second', ts)) FROM events WHERE event_id % 3 = 0 AND event_id <= (SELECT max(event_id) // 2 FROM events))")
def _(spark, d):
    tmp = f"{shared(spark)}/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", F.date_trunc("second", "ts").alias("at"))
    state = StateTable(spark, f"{tmp}/cursors", sync.CURSORS)
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    sync.sync(e.where((F.col("event_id") % 3 == 0) & (F.col("event_id") <= half)), "events", "at", ["event_id"], f"{tmp}/events", state)
    return spark.createDataFrame([(sync.pending(e, "at", state, "events"),)], "pending long")


@query("stream_cursor_sync", "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events")
def _(spark, d):
    tmp = f"{shared(spark)}/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    state = StateTable(spark, f"{tmp}/cursors", sync.CURSORS)
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    sync.sync(e.where(F.col("event_id") <= middle), "events", "event_id", ["event_id"], f"{tmp}/events", state)
    sync.sync(e, "events", "event_id", ["event_id"], f"{tmp}/events", state)
    return spark.read.parquet(f"{tmp}/events")


@query("stream_foreach_batch_upsert", "SELECT DISTINCT event_id, event_type FROM events WHERE event_type IS NOT NULL")
def _(spark, d):
    tmp = f"{shared(spark)}/{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("event_id", "event_type")
    for part in range(2):  # the second file repeats half of the first
        e.where(F.col("event_id") % 4 >= 2 * part - 1).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    sync.stream_into(stream, ["event_id"], f"{tmp}/out", f"{tmp}/checkpoint", gate=lambda df: df.where("event_type is not null")).awaitTermination()
    return spark.read.parquet(f"{tmp}/out")


def shared(spark: SparkSession) -> str:
    return shared_dir(spark)


# extensions
@query("ext_tumbling_window", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("ext_session_window", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions FROM g GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).count().groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("ext_vector_cosine_topk", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.v, e.v) AS s FROM q JOIN e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, CAST(place AS INTEGER) AS place, round(s, 4) AS similarity FROM r WHERE place <= 3")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("v"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return nearest(e, q, 3)
