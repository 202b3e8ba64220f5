import pytest

from grainloom import queries

from .oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], sf_dir)


def test_routing_covers_all_keys(spark, sf_dir):
    got = {r["version"]: r["keys"] for r in queries.QUERIES["simulated_routing"](spark, sf_dir).collect()}
    assert sum(got.values()) == 10_000 and 1500 < got["canary"] < 2500
