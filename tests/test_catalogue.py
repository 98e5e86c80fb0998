import pytest
from twins import compare, views
from vecloom.plans import catalogue, oracles

QUERIES = catalogue.catalogue()


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql_twin(spark, sf, name):
    compare(QUERIES[name](spark, sf), views(sf), oracles.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles.ORACLES)))
def test_without_twin(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 100
    assert set(e.oracle_sql()) <= set(e.queries())


def test_recall_floor(spark):
    """Below 0.9 the recall isn't good enough."""
    ranks = lambda n: spark.range(n).selectExpr("id div 10 AS qid", "id % 10 AS id", "CAST(id % 10 + 1 AS INT) AS rk")
    ok = lambda n: catalogue._found("m", ranks(n), ranks(100)).first()["recall_ok"]
    assert ok(90) and not ok(88)
