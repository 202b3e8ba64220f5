import pytest
from pyspark.sql import functions as F

from grainloom.catalog import Catalog, Registry
from grainloom.errors import Ambiguous, InvalidModel, NonAdditive, Refused, UnknownName, Unreachable
from grainloom.model import Model
from grainloom.plans.graph import dimensions_for, path
from grainloom.plans.planner import broken_keys, explain, plan, shadow_diff
from grainloom.plans.query import Filter, SemanticQuery
from grainloom.queries import model, resolver


def ask(spark, sf_dir, metrics, by="", **how):
    return plan(model(), SemanticQuery(tuple(metrics.split()), tuple(by.split()), **how), resolver(spark, sf_dir))


def test_slices_add_up_to_the_total(spark, sf_dir):
    total = ask(spark, sf_dir, "revenue").first()[0]
    for by in ("customer_region", "brand", "customer_region segment", "order_date"):
        own = ask(spark, sf_dir, "revenue", by).agg(F.sum("revenue")).first()[0]
        assert own == pytest.approx(total)


def test_facts_side_by_side_do_not_inflate(spark, sf_dir):
    both = ask(spark, sf_dir, "revenue event_value", "segment").agg(F.sum("revenue"), F.sum("event_value")).first()
    assert both[0] == pytest.approx(ask(spark, sf_dir, "revenue").first()[0])
    assert both[1] == pytest.approx(ask(spark, sf_dir, "event_value").first()[0])


def test_no_shuffle_above_the_union(spark, sf_dir):
    df = ask(spark, sf_dir, "order_count event_count")
    assert df.columns == ["order_count", "event_count"] and df.count() == 1


@pytest.mark.parametrize(
    ("error", "metrics", "by", "how"),
    [
        (Unreachable, "order_value", "brand", {}),
        (Unreachable, "event_value", "order_status", {}),
        (UnknownName, "profit", "", {}),
        (UnknownName, "revenue", "colour", {}),
        (Refused, "revenue_rolling_3", "segment", {}),
        (NonAdditive, "orders_rolling_3", "order_date", {"time_grain": "month"}),
        (Refused, "revenue", "order_date", {"time_grain": "decade"}),
        (Refused, "revenue", "", {"where": (Filter("segment", "like", ("B%",)),)}),
    ],
)
def test_refusals(spark, sf_dir, error, metrics, by, how):
    with pytest.raises(error):
        ask(spark, sf_dir, metrics, by, **how)


def test_a_filter_value_that_does_not_fit_is_an_error(spark, sf_dir):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        ask(spark, sf_dir, "revenue", where=(Filter("order_date", ">=", ("soon",)),)).collect()


def test_two_ways_are_ambiguous():
    m = Model.of(
        {
            "entities": [{"name": n, "table": n} for n in "abcd"],
            "joins": [{"from": f, "to": t, "from_key": "k", "to_key": "k"} for f, t in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))],
        }
    )
    with pytest.raises(Ambiguous):
        path(m, "a", "d")


def test_model_is_checked():
    with pytest.raises(InvalidModel):
        Model.of({"metrics": [{"name": "a", "formula": "b + 1"}]})
    with pytest.raises(InvalidModel):
        Model.of({"metrics": [{"name": "a", "formula": "b"}, {"name": "b", "formula": "a"}]})
    with pytest.raises(InvalidModel):
        Model.of({"things": []})
    assert {i.severity for i in model().lint()} <= {"warning"}
    m = Model.of({"entities": [{"name": "a", "table": "a"}], "metrics": [{"name": "x", "entity": "a", "agg": "sum", "expr": "v"}, {"name": "y", "formula": "x / x", "description": "d", "synonyms": ["x"]}]})
    assert {(i.target, i.severity) for i in m.lint()} == {("x", "error"), ("y", "error"), ("y", "warning")}
    assert Model.of(model().as_doc()).as_doc() == model().as_doc()


def test_dimensions_of_a_derived_metric_are_those_of_all_its_bases():
    assert dimensions_for(model(), "value_per_customer") == {"customer_region", "customer_nation", "segment", "customer_name", "customer_key"}
    assert "brand" in dimensions_for(model(), "revenue")


def test_last_value_is_that_of_the_latest_row(spark):
    m = Model.of(
        {
            "entities": [{"name": "stock", "table": "stock"}],
            "dimensions": [{"name": "day", "entity": "stock", "column": "d", "type": "time"}, {"name": "item", "entity": "stock", "column": "i"}],
            "metrics": [{"name": "level", "description": "x", "entity": "stock", "agg": "last_value", "expr": "n"}, {"name": "sum3", "description": "x", "of": "level", "window": "rolling:3"}],
        }
    )
    stock = spark.sql("SELECT * FROM VALUES (date'2024-01-01', 'a', 5), (date'2024-01-03', 'a', 2), (date'2024-01-02', 'b', 7) t(d, i, n)")
    r = Catalog(spark, frames={"stock": stock}).resolver(m)
    assert {tuple(x) for x in plan(m, SemanticQuery(("level",), ("item",)), r).collect()} == {("a", 2), ("b", 7)}
    with pytest.raises(NonAdditive):
        plan(m, SemanticQuery(("sum3",), ("day",)), r)


def test_null_keys_meet_and_gaps_stay_null(spark):
    m = Model.of(
        {
            "entities": [{"name": n, "table": n} for n in ("x", "y", "k")],
            "joins": [{"from": n, "to": "k", "from_key": "id", "to_key": "id"} for n in ("x", "y")],
            "dimensions": [{"name": "name", "entity": "k", "column": "name"}],
            "metrics": [{"name": f"s{n}", "entity": n, "agg": "sum", "expr": "v"} for n in ("x", "y")] + [{"name": "both", "formula": "sx + sy"}],
        }
    )
    frames = {
        "x": spark.sql("SELECT * FROM VALUES (1, 10), (null, 1), (9, 2) t(id, v)"),
        "y": spark.sql("SELECT * FROM VALUES (2, 5), (null, 7) t(id, v)"),
        "k": spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b') t(id, name)"),
    }
    got = plan(m, SemanticQuery(("sx", "sy", "both"), ("name",)), Catalog(spark, frames=frames).resolver(m)).collect()
    assert {tuple(r) for r in got} == {("a", 10, None, None), ("b", None, 5, None), (None, 3, 7, 10)}


def test_keys_that_do_not_identify_rows_are_found(spark, sf_dir):
    bad = model().merged({"entities": [{"name": "line_dim", "table": "lineitem"}], "joins": [{"from": "order", "to": "line_dim", "from_key": "o_orderkey", "to_key": "l_orderkey"}]})
    assert broken_keys(model(), resolver(spark, sf_dir)) == {}
    assert "line_dim" in broken_keys(bad, Catalog(spark, sf_dir).resolver(bad))


def test_explain_and_shadow(spark, sf_dir):
    q = SemanticQuery(("sales", "discount_rate"), ("market",))
    assert explain(model(), q) == explain(model(), q) and "customer_region" in explain(model(), q)
    other = model().merged({"metrics": [{"name": "revenue", "description": "x", "entity": "line", "agg": "sum", "expr": "l_extendedprice"}]})
    same = SemanticQuery(("quantity",), ("customer_region",))
    assert shadow_diff(same, model(), other, resolver(spark, sf_dir)).count() == 0
    assert shadow_diff(SemanticQuery(("revenue",)), model(), other, resolver(spark, sf_dir)).count() == 2


def test_registry(spark, sf_dir):
    r = Registry({"a": (Catalog(spark, sf_dir), model()), "b": (Catalog(spark, sf_dir), None)})
    assert r.get()[1] is model() and r.raw("b").explore("region", 2).count() == 2
    with pytest.raises(Refused):
        r.raw("a")
    with pytest.raises(Refused):
        r.get("c")
