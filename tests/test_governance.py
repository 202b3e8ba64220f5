from datetime import datetime

import pytest
from pyspark.sql import functions as F

from grainloom.errors import Forbidden, Refused, TooCostly
from grainloom.governance import AUDIT, SPEND, Governed, Policy, Principal, RowRule, Threat, answer, threat_issues
from grainloom.guard import capped, check_bytes, check_read_only, raw_sql, scanned_bytes, time_limit
from grainloom.plans.query import SemanticQuery
from grainloom.queries import model, resolver
from grainloom.state import Snapshots, StateTable


def test_roles_are_checked_through_formulas(spark, sf_dir):
    m = model().merged({"metrics": [{"name": "balance_each", "description": "x", "formula": "balance / nullif(customer_count, 0)"}]})
    q = SemanticQuery(("balance_each",))
    with pytest.raises(Forbidden):
        answer(m, q, Policy(), Principal("a", "analyst"), resolver(spark, sf_dir))
    assert answer(m, q, Policy(transitive_roles=False), Principal("a", "analyst"), resolver(spark, sf_dir)).count() == 1


def test_row_rule_needs_the_attribute(spark, sf_dir):
    policy = Policy(row_rules=(RowRule(("manager",), "customer_region", "region"),))
    q = SemanticQuery(("revenue",), ("customer_region",))
    with pytest.raises(Forbidden):
        answer(model(), q, policy, Principal("m", "manager"), resolver(spark, sf_dir))
    own = answer(model(), q, policy, Principal("m", "manager", {"region": "ASIA"}), resolver(spark, sf_dir)).collect()
    assert [r["customer_region"] for r in own] == ["ASIA"]


def test_a_requested_count_survives_suppression_and_the_limit_comes_after_it(spark, sf_dir):
    policy = Policy(k=8, count_metric="customer_count", protected=("customer_nation",))
    q = SemanticQuery(("customer_count",), ("customer_nation",), order_by=(("customer_count", False),), limit=3)
    got = answer(model(), q, policy, Principal("a", "analyst"), resolver(spark, sf_dir)).collect()
    assert [c for c in got[0].asDict()] == ["customer_nation", "customer_count"]
    assert all(r["customer_count"] >= 8 for r in got)
    whole = answer(model(), q, policy, Principal("a", "admin"), resolver(spark, sf_dir)).collect()
    assert min(r["customer_count"] for r in whole) <= min(r["customer_count"] for r in got)


def test_masks_keep_groups_apart(spark, sf_dir):
    q = SemanticQuery(("customer_count",), ("customer_name",))
    got = answer(model(), q, Policy(), Principal("a", "analyst"), resolver(spark, sf_dir))
    assert got.count() == 150 and {r[0] for r in got.select("customer_name").collect()} == {"***"}
    assert answer(model(), q, Policy(), Principal("a", "admin"), resolver(spark, sf_dir)).where("customer_name = '***'").count() == 0


def test_budget_audit_and_charge(spark, sf_dir, tmp_path):
    g = Governed(model(), Policy(budgets={"t": 2.0}), resolver(spark, sf_dir), StateTable(spark, f"{tmp_path}/audit", AUDIT), StateTable(spark, f"{tmp_path}/spend", SPEND), lambda: datetime(2024, 1, 1))
    who = Principal("u", "analyst", {"tenant": "t"}, question="how many?")
    g.ask(SemanticQuery(("order_count",)), who)
    with pytest.raises(Refused):
        g.ask(SemanticQuery(("balance",)), who)
    g.ask(SemanticQuery(("order_count",)), who)
    with pytest.raises(Forbidden):
        g.ask(SemanticQuery(("order_count",)), who)
    assert g.spent("t") == 2.0
    assert g.audit.read().groupBy("refused").count().orderBy("refused").collect() == [(False, 2), (True, 2)]
    g.reset("t")
    assert g.spent("t") == 0.0
    assert {r["tenant"]: r["spent"] for r in g.by_tenant().collect()} == {"t": 0.0}


@pytest.mark.parametrize("sql", ["select 1", "WITH a AS (SELECT 1) SELECT * FROM a;", "select 'drop table x; delete' as update_note", "-- insert\nselect created_at from t", 'select "delete" from t'])
def test_read_only_statements(sql):
    check_read_only(sql)


@pytest.mark.parametrize("sql", ["", "drop table x", "select 1; select 2", "with a as (select 1) insert into b select * from a", "/* select */ update t set a = 1", "select * from t where exists (merge into x)"])
def test_statements_that_write_are_refused(sql):
    with pytest.raises(Refused):
        check_read_only(sql)


def test_limits(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert scanned_bytes(df) > 1000
    with pytest.raises(TooCostly):
        check_bytes(df, 100)
    check_bytes(df, None)
    assert capped(df, 10)[1] and not capped(df.limit(3), 10)[1]
    assert raw_sql(spark, "select 1 as a").collect() == [(1,)]
    with time_limit(spark, 60):
        assert df.count() == 1500


def test_snapshots_move_together(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path))
    s.commit({"a": spark.range(3), "b": spark.range(2)})
    before = s.commit({"a": spark.range(5)})
    assert (s.table("a").count(), s.table("b").count()) == (5, 2)
    s.point(before)
    assert s.table("a").count() == 3


def test_threats():
    ok = Threat("t1", "x", "v", "c", "o", "mitigated")
    assert threat_issues([ok]) == []
    assert len(threat_issues([ok, Threat("t1", "", "v", "c", "o", "open")])) == 3


def test_decoded_metrics_stay_arrays(spark, tmp_path):
    t = StateTable(spark, f"{tmp_path}/x", AUDIT)
    assert t.read().count() == 0
    t.append([(datetime(2024, 1, 1), "u", "r", ["a", "b"], [], False, "", "", "", "")])
    assert t.read().select(F.size("metrics")).first()[0] == 2
